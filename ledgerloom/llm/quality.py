"""Quality scores by histogram gradient-boosted trees over document statistics (operator 8)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_texts
from ledgerloom.llm.language_id import flat_bytes
from ledgerloom.llm.text_hash import NOT_SPACE, hashes, spans

#: Labelled documents that are learned from at most.
TRAIN_ROWS = 16_000
BINS, TREES, DEPTH, RATE, LEAF, RIDGE = 64, 80, 4, 0.15, 8, 1.0

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (9, 11, 12, 13, 32), "line": (10,),
    "stop": b".,;:?'\"-", "shout": b"!", "bar": b"|", "symbol": b"#$%&*+/<=>@[\\]^_`{}~", "bracket": b"()", "wide": range(128, 256),
}
_CLASS = np.zeros(256, np.int64) + len(_CLASSES)
for _i, _bytes in enumerate(_CLASSES.values()):
    _CLASS[list(_bytes)] = _i
_NOT_LINE = np.ones(256, bool)
_NOT_LINE[10] = False
STATISTICS = ["log_bytes", *_CLASSES, "words", "word_len", "word_max", "distinct", "repeats", "pairs_distinct", "marked", "capitals", "lines", "line_words", "lines_distinct", "top_word", "numbers"]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1), np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _distinct(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each text, and the count of its most frequent one."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(keys)))
    most = np.zeros(len(first) - 1)
    np.maximum.at(most, text[at], runs)
    return np.bincount(text[at], minlength=len(first) - 1), most


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """texts x STATISTICS, over whole texts; an empty text has zeros."""
    n, size = len(offsets) - 1, np.diff(offsets)
    kinds = len(_CLASSES) + 1
    out = np.zeros((n, len(STATISTICS)))
    out[:, 0] = np.log1p(size)
    text_of = np.repeat(np.arange(n) * kinds, size)
    out[:, 1:kinds] = np.bincount(text_of + _CLASS[buf], minlength=n * kinds).reshape(n, kinds)[:, :-1] / np.maximum(size, 1)[:, None]
    starts, stops, first = spans(buf, offsets, NOT_SPACE)
    words = np.diff(first)
    per = np.maximum(words, 1)
    key = hashes(buf, starts, stops)
    length = stops - starts
    longest = np.zeros(n)
    np.maximum.at(longest, np.repeat(np.arange(n), words), length)
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    same[first[:-1][words > 0]] = False
    pair = key.copy()
    pair[1:] = key[1:] * np.uint64(3) + key[:-1]
    odd = np.isin(_CLASS, [list(_CLASSES).index(x) for x in ("shout", "bar", "symbol")])[buf]
    marks, big = np.concatenate([[0], np.cumsum(odd)]), np.concatenate([[0], np.cumsum(_CLASS[buf] == 0)])
    nums = np.concatenate([[0], np.cumsum(_CLASS[buf] == 2)])
    distinct, top = _distinct(key, first)
    pairs, _ = _distinct(pair, first)
    a, b, at = spans(buf, offsets, _NOT_LINE)
    lines = np.diff(at)
    kinds_of_line, _ = _distinct(hashes(buf, a, b), at)
    out[:, kinds:] = np.stack([
        np.log1p(words), _sums(length, first) / per, longest, distinct / per, _sums(same, first) / per, pairs / per,
        _sums(marks[stops] > marks[starts], first) / per, _sums((big[stops] - big[starts] >= 2), first) / per, np.log1p(lines),
        words / np.maximum(lines, 1), kinds_of_line / np.maximum(lines, 1), top / per, _sums(nums[stops] > nums[starts], first) / per,
    ], axis=1)
    return out


@dataclass
class Forest:
    """Trees as flat arrays, each of 2**DEPTH - 1 inner nodes in level order: feature, threshold; then 2**DEPTH leaf values."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        raw, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            raw += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray) -> Forest:
    """Logistic gradient boosting on histograms of quantile bins."""
    inner = 2**DEPTH - 1
    if not len(y):
        return Forest(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    p0 = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(p0 / (1 - p0)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)  # bin <= b: x <= cuts[b]
    raw = np.full(len(y), base)
    features, thresholds, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            lo, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            split = np.full((width, 2), -1)
            for j in range(x.shape[1]):
                if not len(cuts[j]):
                    continue
                at, m = (node - lo) * (len(cuts[j]) + 1) + bins[:, j], width * (len(cuts[j]) + 1)
                gs, hs, ns = (np.bincount(at, w, m).reshape(width, -1).cumsum(axis=1) for w in (g, h, None))
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
                gain = np.where((ns >= LEAF) & (nt - ns >= LEAF), gain, -1)[:, :-1]
                top = gain.argmax(axis=1)
                value = gain[np.arange(width), top]
                better = value > best
                best[better] = value[better]
                split[better] = np.stack([np.full(width, j), top], axis=1)[better]
            for i, (j, b) in enumerate(split):
                if j >= 0:
                    feature[lo + i], threshold[lo + i] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - inner
        leaf = -RATE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + RIDGE)
        raw += leaf[at]
        features.append(feature), thresholds.append(threshold), leaves.append(leaf)
    return Forest(base, np.array(features), np.array(thresholds), np.array(leaves))


def labelled_ids(labels: DataFrame, label: str, doc_id: str, rows: int) -> DataFrame:
    """(_label_id, _y) for at most about `rows` hash-chosen ids of the labels; of several labels of an id the largest counts."""
    known = labels.select(F.col(doc_id).alias("_label_id"), F.col(label).cast("int").alias("_y")).where("_label_id IS NOT NULL AND _y IS NOT NULL").groupBy("_label_id").agg(F.max("_y").alias("_y"))
    n = known.count()
    return known if n <= rows else known.where(F.pmod(F.xxhash64("_label_id"), F.lit(1 << 20)) < int(rows / n * (1 << 20)))


def labelled_texts(documents: DataFrame, ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_label_id, _y, _t): one text for each of the ids; of several, null apart, that of least hash."""
    rows = documents.select(F.col(doc_id).alias("_of"), F.col(text).alias("_t")).where("_t IS NOT NULL")
    rows = rows.join(F.broadcast(ids), F.col("_of") == F.col("_label_id"))  # about TRAIN_ROWS ids at most
    return rows.groupBy("_label_id", "_y").agg(F.min_by("_t", F.xxhash64("_t")).alias("_t"))


def learn(documents: DataFrame, labels: DataFrame, learn_from: Column, doc_id: str, text: str, label: str) -> Forest:
    rows = labelled_texts(documents, labelled_ids(labels.where(learn_from), label, doc_id, TRAIN_ROWS), doc_id, text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(*flat_bytes(batch.column("_text")))
        return pa.RecordBatch.from_arrays([batch.column("_label_id"), batch.column("_y"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["_label_id", "_y", "x"])

    got = map_texts(rows, "_t", ["_label_id", "_y"], run, "x array<double>").orderBy("_label_id").collect()
    return boost(np.array([r.x for r in got]).reshape(len(got), len(STATISTICS)), np.array([r._y for r in got], float))


def score_quality(documents: DataFrame, labels: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for every row, from statistics of the whole text alone.

    `learn_from` chooses the label rows that may be learned from, of which at most about TRAIN_ROWS are, each with one text. Null texts
    count as empty, and empty texts are scored like others; without labels every score is 0.5. Repeated rows get the same score; ids
    may be of any type, and other columns of any name are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(learn(documents, labels, learn_from, doc_id, text, label))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = shared.value.score(statistics(*flat_bytes(batch.column("_text"))))
        return pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], names=["_id", "score", "predicted"])

    return map_texts(documents.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")), "_t", ["_id"], run, "score double, predicted int").withColumnRenamed("_id", doc_id)

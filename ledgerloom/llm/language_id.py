"""Language identification by prediction by partial matching over frozen byte context trees (operator 3)."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import map_texts, small_batches

#: Documents that each language is learned from at most, and the bytes after which no further one is taken.
PER_LANGUAGE, LANGUAGE_BYTES = 400, 400 * 16384
#: Bytes that contexts reach back; occurrences that make a context a node.
ORDER, NODE_COUNT = 3, 4
#: Bytes of the tables for each language, and for all at most. Where nodes would take more, they need more occurrences, with a warning.
TABLE_BYTES, ALL_TABLES = 3 << 20, 96 << 20
_CHUNK = 1 << 18


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower-case ASCII letters and the two-byte Latin-1 capitals of UTF-8."""
    out = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    after = np.concatenate([[False], buf[:-1] == 0xC3]) if len(buf) else np.zeros(0, bool)
    return np.where(after & (buf >= 0x80) & (buf <= 0x9E), out + 0x20, out).astype(np.uint8)


def has_letter(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; only texts without an ASCII letter are decoded."""
    seen = np.concatenate([[0], np.cumsum(((buf | 32) >= 97) & ((buf | 32) <= 122))])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(map(str.isalpha, buf[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


@dataclass
class Trees:
    """symbols: class of each byte (0: never learned). pairs: two preceding classes -> row of `contexts`, and row and third class
    -> node, the longest known suffix. bits: language x (node, class) -> code length under that node, escapes included."""

    languages: list[str]
    symbols: np.ndarray
    width: int
    pairs: np.ndarray
    contexts: np.ndarray
    bits: np.ndarray

    def lengths(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each text, per language: texts x languages."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        past = np.zeros(ORDER, np.int32)
        begin = offsets[0]
        starts = offsets[:-1]
        for lo in range(begin, offsets[-1], _CHUNK):
            hi = min(lo + _CHUNK, offsets[-1])
            head = np.zeros(1, np.uint8) if lo == begin else buf[lo - 1 : lo]
            cur = self.symbols[fold(np.concatenate([head, buf[lo:hi]]))[1:]].astype(np.int32)
            line = np.concatenate([past, cur])
            past = line[-ORDER:].copy()
            prev = [line[ORDER - 1 - i : len(line) - 1 - i].copy() for i in range(ORDER)]
            for i in range(ORDER):  # a text begins with empty contexts
                for back in range(i + 1):
                    at = starts[(starts + back >= lo) & (starts + back < hi)] + back - lo
                    prev[i][at] = 0
            row = self.pairs[prev[1] * self.width + prev[0]]
            key = self.contexts[row * self.width + prev[2]] * self.width + cur
            first = np.searchsorted(offsets, lo, "right") - 1
            last = np.searchsorted(offsets, hi, "left")
            edges = np.clip(offsets[first:last], lo, hi) - lo
            full = np.diff(np.append(edges, hi - lo)) > 0
            for n in range(len(self.languages)):
                sums = np.add.reduceat(self.bits[n][key], np.minimum(edges, len(key) - 1), dtype=np.float64)
                out[first:last, n] += np.where(full, sums, 0)
        return out


def learn(samples: list[tuple[str, bytes]], table_bytes: int | None = None) -> Trees | None:
    """Trees of every language from (language, text) pairs; frequencies stay as learned. The tables of all take `table_bytes` at most."""
    if not samples:
        return None
    languages = sorted({x for x, _ in samples})
    texts = [fold(np.frombuffer(t, np.uint8)) for _, t in samples]
    seen = np.bincount(np.concatenate(texts), minlength=256)
    symbols = np.zeros(256, np.uint8 if (seen > 0).sum() < 256 else np.uint16)
    symbols[np.flatnonzero(seen)] = np.arange(1, (seen > 0).sum() + 1)
    width = int((seen > 0).sum()) + 1
    prev: list[list[np.ndarray]] = [[] for _ in range(ORDER)]
    cur, who = [], []
    for (name, _), text in zip(samples, texts, strict=True):
        line = np.concatenate([np.zeros(ORDER, np.int32), symbols[text].astype(np.int32)])  # width**ORDER fits
        for i in range(ORDER):
            prev[i].append(line[ORDER - 1 - i : len(line) - 1 - i])
        cur.append(line[ORDER:])
        who.append(np.full(len(text), languages.index(name), np.int32))
    back, now, whose = [np.concatenate(p) for p in prev], np.concatenate(cur), np.concatenate(who)
    codes = [np.zeros_like(now), back[0], back[1] * width + back[0], (back[2] * width + back[1]) * width + back[0]]
    least, room = NODE_COUNT, table_bytes or min(ALL_TABLES, TABLE_BYTES * max(4, len(languages)))
    while True:
        nodes = []
        for order in range(ORDER + 1):
            u, n = np.unique(codes[order], return_counts=True)
            nodes.append(u[n >= least].astype(np.int64) if order else np.zeros(1, np.int64))
        if (sum(map(len, nodes)) * len(languages) + len(nodes[2]) + 2 * width) * width * 4 <= room or least > 1 << 20:
            break
        least *= 2
    if least > NODE_COUNT:
        warnings.warn(f"contexts need {least} occurrences to be nodes, not {NODE_COUNT}: the tables of {len(languages)} languages would take more than {room} bytes", stacklevel=2)
    base = np.concatenate([[0], np.cumsum([len(x) for x in nodes])])
    bits = np.zeros((len(languages), base[-1], width), np.float32)
    one = np.zeros(width, np.int32)
    one[nodes[1]] = base[1] + np.arange(len(nodes[1]))
    two = np.tile(one, width)  # the oldest symbol is the most significant
    two[nodes[2]] = base[2] + np.arange(len(nodes[2]))
    row = [np.zeros(1, np.int32), one, two]
    # a row for each last symbol, where no longer context is known, and one for each known pair; a known triple ends with a known pair
    pairs = np.tile(np.arange(width, dtype=np.int32), width)
    pairs[nodes[2]] = width + np.arange(len(nodes[2]))
    contexts = np.repeat(np.concatenate([one, two[nodes[2]]])[:, None], width, axis=1)
    contexts[pairs[nodes[3] % width**2], nodes[3] // width**2] = base[3] + np.arange(len(nodes[3]))
    for n in range(len(languages)):
        mine = whose == n
        for order in range(ORDER + 1):
            inner = np.searchsorted(nodes[order], codes[order][mine])
            inner = np.minimum(inner, len(nodes[order]) - 1)
            known = nodes[order][inner] == codes[order][mine] if len(nodes[order]) else np.zeros(mine.sum(), bool)
            counts = np.bincount(inner[known] * width + now[mine][known], minlength=len(nodes[order]) * width).reshape(-1, width).astype(np.float64)
            total, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
            if order:
                shorter = row[order - 1][nodes[order] % width ** (order - 1)]
                below = bits[n][shorter].astype(np.float64)
            else:
                below = np.full((1, width), 8.0)  # under the empty context, any of 256 bytes
            with np.errstate(divide="ignore", invalid="ignore"):
                own = -np.log2(counts / (total + kinds))
                escape = -np.log2(kinds / (total + kinds)) + below
            bits[n, base[order] : base[order + 1]] = np.where(total == 0, below, np.where(counts > 0, own, escape))
    return Trees(languages, symbols, width, pairs, contexts.reshape(-1).astype(np.int32), bits.reshape(len(languages), -1))


def training_sample(documents: DataFrame, learn_from: Column, doc_id: str, text: str, lang: str) -> list[tuple[str, bytes]]:
    """Up to PER_LANGUAGE hash-chosen documents of each language, whole, among the usable ones: that may be learned from and have a text.

    Rows of equal id and text are one document. No document is taken once the ones before have LANGUAGE_BYTES; those that alone
    are larger come last, so they are taken only where the others are too few, and every language with a text is learned.
    """
    key = F.xxhash64(F.col(doc_id), F.col(text)).alias("_h")
    pool = documents.where(learn_from & F.col(lang).isNotNull() & (F.octet_length(text) > 0)).select(F.col(lang).cast("string").alias("_lang"), key, F.col(text).cast("binary").alias("_bytes"))
    counts = {r[0]: r[1] for r in pool.groupBy("_lang").agg(F.approx_count_distinct("_h")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2 * PER_LANGUAGE / max(n, 1)))])  # twice, as counts are approximate
    draw = F.pmod("_h", F.lit(1 << 40))
    drawn = pool.where(draw < share[F.col("_lang")] * (1 << 40)).select("_lang", "_h", F.octet_length("_bytes").cast("long").alias("_size"))
    order = Window.partitionBy("_lang").orderBy(F.col("_size") > LANGUAGE_BYTES, draw, "_h")
    before = F.coalesce(F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = drawn.groupBy("_lang", "_h").agg(F.max("_size").alias("_size")).withColumns({"_rank": F.row_number().over(order), "_before": before})
    chosen = ranked.where((F.col("_rank") <= PER_LANGUAGE) & (F.col("_before") < LANGUAGE_BYTES)).select("_lang", "_h").collect()
    wanted = documents.sparkSession.createDataFrame([tuple(r) for r in chosen], "_lang string, _h long")
    rows = pool.join(F.broadcast(wanted), ["_lang", "_h"]).select("_lang", "_h", "_bytes")
    small_batches(documents.sparkSession)
    once = rows.mapInArrow(_first_of_each, rows.schema).dropDuplicates(["_lang", "_h"])
    return sorted((r[0], bytes(r[1])) for r in once.select("_lang", "_bytes").collect())


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each (language, key) of a task, so that copies are not brought together."""
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        keep = []
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if key not in seen:
                seen.add(key)
                keep.append(i)
        if keep:
            yield batch.take(pa.array(keep, pa.int32()))


def identify(documents: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang_pred, score for every row; whole texts are coded.

    The language with the shortest code wins, ties to the smaller name; score is its share of the likelihood. Texts that are
    null or have no letter get `und` and 0.0, and so does everything if nothing can be learned. Only `text` decides: repeated rows get
    the same answer, very long texts are coded piece by piece, an empty table gives none, and other columns of any name are not read.
    """
    trees = learn(training_sample(documents, learn_from, doc_id, text, lang))
    shared = documents.sparkSession.sparkContext.broadcast(trees)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, texts = shared.value, batch.column("_text")
        buf, offsets = flat_bytes(texts)
        letters = has_letter(buf, offsets)
        named, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
        if model is not None and letters.any():
            bits = model.lengths(buf, offsets)
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(bits)), best]
            share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            named = np.where(letters, np.array(model.languages, object)[best], "und")
            score = np.where(letters, share, 0.0)
        return pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(named, pa.string()), pa.array(score, pa.float64())], names=["_id", "lang_pred", "score"])

    rows = documents.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t"))
    return map_texts(rows, "_t", ["_id"], run, "lang_pred string, score double").withColumnRenamed("_id", doc_id)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins, the end last; a null text has none."""
    texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_binary(texts.type) else np.int64, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]

"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy (operator 10)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.llm.common import map_texts, release_memory
from ledgerloom.llm.language_id import flat_bytes, fold
from ledgerloom.llm.quality import labelled_ids, labelled_texts
from ledgerloom.llm.text_hash import ALNUM, hashes, spans

#: Labelled documents that are learned from at most, and the bytes after which no further one is taken.
TRAIN_ROWS, TRAIN_BYTES = 4_000, 8 << 20
#: Words of a window, and words from one window to the next: each word but the first few is scored in two windows.
WINDOW, STEP = 16, 8
#: Units of each direction, of the attention; dimensions of a word's and of a character trigram's embedding; hash buckets of trigrams.
HIDDEN, ATTEND, WORDS, CHARS, BUCKETS = 8, 8, 8, 6, 4096
#: Learned texts that have a word, from which it has an embedding of its own; part of the words that are hidden while learning.
LEAST_TEXTS, DROPPED = 6, 0.3
_INPUTS = WORDS + CHARS
_ROWS = 2048


@dataclass
class Words:
    """The words of a batch: first word of each text, index of each word into the distinct ones, and what these look like."""

    first: np.ndarray
    index: np.ndarray
    keys: np.ndarray  # hashes of the distinct words
    grams: np.ndarray  # trigram buckets of the distinct words, word after word
    begin: np.ndarray


def read_words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """Words are runs of letters, digits and non-ASCII bytes, lower-cased."""
    buf = fold(buf)
    starts, stops, first = spans(buf, offsets, ALNUM)
    keys, at, index = np.unique(hashes(buf, starts, stops), return_index=True, return_inverse=True)
    order = np.argsort(at)  # by place, as hashes() wants them
    keys, at = keys[order], at[order]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    a, b = starts[at], stops[at]
    size = b - a + 2  # trigrams of the word between two marks
    begin = np.concatenate([[0], np.cumsum(size - 2)])
    place = np.repeat(a - begin[:-1], size - 2) + np.arange(begin[-1])
    whose = np.repeat(np.arange(len(at)), size - 2)
    mark = np.zeros(1, np.uint8)
    padded = np.concatenate([mark, buf, mark])  # so place + 1 is the byte itself
    before = np.where(place > a[whose], padded[place], 0).astype(np.uint32)
    after = np.where(place < b[whose] - 1, padded[place + 2], 0).astype(np.uint32)
    grams = ((before * np.uint32(257) + padded[place + 1]) * np.uint32(257) + after) * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return Words(first, back[index.reshape(-1)].astype(np.int32), keys, grams.astype(np.int32), begin)


def window_starts(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window and the text of each window; windows overlap and cover every word of every text."""
    n = np.diff(first)
    count = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - WINDOW) // STEP)))
    text = np.repeat(np.arange(len(n)), count)
    return first[text] + STEP * (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Network:
    """Words and their trigrams -> embeddings -> GRU in both directions -> attention over the words -> one logit a window.

    V holds an embedding for each word of the vocabulary, after that of all other words; E one for each bucket of trigrams.
    """

    def __init__(self, seed: int = 7, vocabulary: int = 0):
        r = np.random.default_rng(seed)
        shape = {"V": (1 + vocabulary, WORDS), "E": (BUCKETS, CHARS), "A": (2 * HIDDEN, ATTEND), "v": (ATTEND,), "w": (2 * HIDDEN,), "b": (1,)}
        for d in "fb":
            shape |= {f"W{d}": (_INPUTS, 3 * HIDDEN), f"U{d}": (HIDDEN, 3 * HIDDEN), f"c{d}": (3 * HIDDEN,)}
        self.p = {k: (r.normal(0, 0.3 if k[0] in "WUA" else 0.1, s) if len(s) > 1 or k in "vw" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}

    def embed(self, grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
        if len(begin) < 2:
            return np.zeros((0, CHARS), np.float32)
        sums = np.concatenate([np.zeros((1, CHARS)), np.cumsum(self.p["E"][grams], axis=0, dtype=np.float64)])
        return ((sums[begin[1:]] - sums[begin[:-1]]) / (begin[1:] - begin[:-1])[:, None]).astype(np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States (steps x rows x HIDDEN) over projected inputs (steps x rows x 3 HIDDEN); masked steps keep the state."""
        u, h = self.p[f"U{d}"], np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((len(x), x.shape[1], HIDDEN), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g = h @ u
            zr = _sigmoid(x[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[t, :, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            z = z * mask[t][:, None]
            new = h + z * (n - h)
            if keep is not None:
                keep.append((t, h, z, r, n, g[:, 2 * HIDDEN :]))
            h = out[t] = new
        return out

    def forward(self, f: np.ndarray, b: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits from projected inputs of both directions (steps x rows x 3 HIDDEN)."""
        tapes = ([], []) if keep is not None else (None, None)
        h = np.concatenate([self._run(f, mask, "f", tapes[0]), self._run(b, mask, "b", tapes[1])], axis=2)
        k = np.tanh(h @ self.p["A"])
        e = np.where(mask > 0, k @ self.p["v"], np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        a = e / e.sum(axis=0)
        pooled = np.einsum("tr,trh->rh", a, h)
        if keep is not None:
            keep |= {"h": h, "k": k, "a": a, "pooled": pooled, "tapes": tapes}
        return pooled @ self.p["w"] + self.p["b"][0]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weighted logistic loss, and that of the inputs (steps x rows x _INPUTS)."""
        p, keep = self.p, {}
        logit = self.forward(x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"], mask, keep)
        dl = ((_sigmoid(logit) - y) * weight / max(weight.sum(), 1e-6)).astype(np.float32)
        h, k, a, pooled = (keep[n] for n in ("h", "k", "a", "pooled"))
        g = {"w": pooled.T @ dl, "b": dl.sum(keepdims=True)}
        dp = dl[:, None] * p["w"]
        dh = a[:, :, None] * dp[None]
        da = np.einsum("trh,rh->tr", h, dp)
        de = a * (da - (a * da).sum(axis=0))
        g["v"] = np.einsum("tr,tra->a", de, k)
        dk = de[:, :, None] * p["v"] * (1 - k * k)
        g["A"] = np.einsum("trh,tra->ha", h, dk)
        dh = dh + dk @ p["A"].T
        dx = np.zeros_like(x)
        for d, tape, part in (("f", keep["tapes"][0], slice(0, HIDDEN)), ("b", keep["tapes"][1], slice(HIDDEN, 2 * HIDDEN))):
            u, carry, du = p[f"U{d}"], np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros_like(p[f"U{d}"])
            dproj = np.empty((*x.shape[:2], 3 * HIDDEN), np.float32)
            for t, old, z, r, n, gn in reversed(tape):
                total = carry + dh[t, :, part]
                zz = np.where(mask[t][:, None] > 0, z, 0)
                dn = total * zz * (1 - n * n)
                dz = total * (n - old) * zz * (1 - zz)
                dr = dn * gn * r * (1 - r)
                dproj[t] = np.concatenate([dz, dr, dn], axis=1)
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                du += old.T @ dg
                carry = total * (1 - zz) + dg @ u.T
            g[f"U{d}"] = du
            g[f"W{d}"] = np.einsum("tri,trg->ig", x, dproj)
            g[f"c{d}"] = dproj.sum(axis=(0, 1))
            dx += dproj @ p[f"W{d}"].T
        return g, dx


@dataclass
class Model:
    network: Network
    keys: np.ndarray  # sorted hashes of the words of the vocabulary
    scale: tuple[float, float]  # document score = sigmoid(scale[0] * largest window logit + scale[1])

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Rows of V."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at + 1, 0)

    def window_logits(self, words: Words, starts: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Logits of windows: what is the same for all places of a word is computed once per distinct word."""
        p = self.network.p
        x = np.concatenate([p["V"][self.look_up(words.keys)], self.network.embed(words.grams, words.begin)], axis=1)
        f, b = x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]
        out = np.empty(len(starts), np.float32)
        for lo in range(0, len(starts), _ROWS):
            at = starts[lo : lo + _ROWS, None] + np.arange(WINDOW)
            mask = (at < words.first[text[lo : lo + _ROWS] + 1][:, None]).T.astype(np.float32)
            place = words.index[np.minimum(at, len(words.index) - 1)].T
            out[lo : lo + _ROWS] = self.network.forward(f[place], b[place], mask)
        return out

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        words = read_words(buf, offsets)
        starts, text = window_starts(words.first)
        most = np.full(len(offsets) - 1, self.floor(), np.float64)
        np.maximum.at(most, text, self.window_logits(words, starts, text))
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * most + self.scale[1], -30, 30)))

    @staticmethod
    def floor() -> float:
        return -8.0  # the logit of a text without words


def word_weights(text: np.ndarray, word: np.ndarray, y: np.ndarray, n: int, rounds: int = 150, penalty: float = 2e-4) -> np.ndarray:
    """Weights of n words by logistic regression of the texts' labels on the words that they have (pairs text, word), kept sparse by a
    penalty on their size (accelerated proximal gradient). Where the first coordinate of the embeddings starts."""
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    width = np.sqrt(np.maximum(np.bincount(text, minlength=len(y)), 1))
    weight, bias, ahead, t = np.zeros(n), 0.0, np.zeros(n), 1.0
    for _ in range(rounds):
        margin = np.bincount(text, ahead[word], len(y)) / width + bias
        slope = balance * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y)
        step = ahead - 20.0 * np.bincount(word, (slope / width)[text], n)
        new = np.sign(step) * np.maximum(np.abs(step) - 20.0 * penalty, 0)
        bias -= 2.0 * slope.sum()
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, weight = new + (before - 1) / t * (new - weight), new
    return weight


def learn(samples: list[tuple[int, bytes]], rounds: int = 2, steps: int = 250) -> Model:
    """From (label, text): embeddings and network, on the most suspicious windows of each text.

    Words that LEAST_TEXTS have get embeddings, whose first coordinate starts as the word's weight in a sparse regression on whole
    texts; from then on all are learned with the network. Each round chooses windows anew, the first by these weights, the next by the
    network: of a toxic text the worst one, of a clean text the worst ones and a random one. Hidden words make it use characters, too.
    """
    y = np.array([s[0] for s in samples], np.float32)
    nothing = np.zeros(0, np.uint64)
    if not len(y) or y.min() == y.max():
        return Model(Network(), nothing, (0.0, -4.0 if not len(y) or y.max() < 1 else 4.0))
    texts = [np.frombuffer(t, np.uint8) for _, t in samples]
    words = read_words(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    del texts
    doc = np.repeat(np.arange(len(y)), np.diff(words.first))
    pairs = np.unique(doc * len(words.keys) + words.index)
    del doc
    known = np.bincount(pairs % len(words.keys), minlength=len(words.keys)) >= LEAST_TEXTS
    order = np.flatnonzero(known)[np.argsort(words.keys[known])]
    row = np.zeros(len(words.keys), np.int64)  # of V, for each distinct word
    row[order] = 1 + np.arange(len(order))
    network = Network(vocabulary=len(order))
    model = Model(network, words.keys[order], (1.0, 0.0))
    pairs = pairs[known[pairs % len(words.keys)]]
    weights = word_weights(pairs // len(words.keys), row[pairs % len(words.keys)] - 1, y, len(order))
    del pairs
    network.p["V"][1:, 0] = weights / max(np.abs(weights).max(initial=0), 1e-6)
    starts, text = window_starts(words.first)
    if not len(starts):
        return Model(network, model.keys, (0.0, float(np.log(y.mean() / (1 - y.mean())))))

    def places(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words (steps x rows) of windows, and which of them are in the window's text."""
        at = (starts[rows, None] + np.arange(WINDOW)).T
        return words.index[np.minimum(at, len(words.index) - 1)], (at < words.first[text[rows] + 1]).astype(np.float32)

    suspicion = np.empty(len(starts), np.float32)
    for lo in range(0, len(starts), 8 * _ROWS):
        rows = np.arange(lo, min(lo + 8 * _ROWS, len(starts)))
        place, mask = places(rows)
        suspicion[rows] = np.where(mask > 0, network.p["V"][row[place], 0], -9).max(axis=0)
    r = np.random.default_rng(11)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    step = 0
    for turn in range(rounds):
        order = np.lexsort((-suspicion, text))
        rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        chosen = order[(rank == 0) | ((rank < 3) & (y[text[order]] == 0))]
        spare = r.choice(len(starts), min(len(starts), len(y)), replace=False)
        chosen = np.concatenate([chosen, spare[y[text[spare]] == 0]])
        label = y[text[chosen]]
        weight = np.where(label > 0, max(1.0, 0.5 * (label == 0).sum() / max((label > 0).sum(), 1)), 1.0).astype(np.float32)
        for _ in range(max(3, min(100, steps * 512 // len(chosen)))):
            mixed = r.permutation(len(chosen))
            for lo in range(0, len(mixed), 512):
                rows = chosen[mixed[lo : lo + 512]]
                place, mask = places(rows)
                u, back = np.unique(place, return_inverse=True)
                back = back.reshape(place.shape)
                n = words.begin[u + 1] - words.begin[u]
                begin = np.concatenate([[0], np.cumsum(n)])
                grams = words.grams[np.repeat(words.begin[u] - begin[:-1], n) + np.arange(begin[-1])]
                seen = np.where(r.random(place.shape) < DROPPED, 0, row[place])
                x = np.concatenate([network.p["V"][seen], network.embed(grams, begin)[back]], axis=2)
                g, dx = network.gradient(x, mask, y[text[rows]], weight[mixed[lo : lo + 512]])
                g["V"] = np.stack([np.bincount(seen.reshape(-1), dx[:, :, j].reshape(-1), len(network.p["V"])) for j in range(WORDS)], axis=1)
                de = np.stack([np.bincount(back.reshape(-1), dx[:, :, WORDS + j].reshape(-1), len(u)) for j in range(CHARS)], axis=1)
                de = np.repeat(de / n[:, None], n, axis=0)
                g["E"] = np.stack([np.bincount(grams, de[:, j], BUCKETS) for j in range(CHARS)], axis=1)
                step += 1
                for name, value in network.p.items():  # Adam
                    m, v = moments[name]
                    m += 0.1 * (g[name] - m)
                    v += 0.001 * (g[name] ** 2 - v)
                    value -= (0.01 * (0.5**turn) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        suspicion = model.window_logits(words, starts, text)
    most = np.full(len(y), Model.floor())
    np.maximum.at(most, text, suspicion)
    a, b = 1.0, 0.0
    for _ in range(200):  # logistic fit of the labels to the worst window
        q = 1 / (1 + np.exp(-np.clip(a * most + b, -30, 30)))
        h = np.maximum(q * (1 - q), 1e-6)
        x = np.stack([most, np.ones_like(most)], axis=1)
        delta = np.linalg.solve((x * h[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (q - y) + 1e-3 * np.array([a - 1, b]))
        a, b = a - 0.5 * delta[0], b - 0.5 * delta[1]
    model.scale = (float(a), float(b))
    return model


def training_sample(documents: DataFrame, labels: DataFrame, learn_from: Column, doc_id: str, text: str, label: str) -> list[tuple[int, bytes]]:
    """At most about TRAIN_ROWS hash-chosen labelled texts, whole and of any length, one an id, until they have TRAIN_BYTES.

    Texts that alone are larger come last, and the smallest of them first, so they are taken only where the others are too few.
    """
    rows = labelled_texts(documents, labelled_ids(labels.where(learn_from), label, doc_id, TRAIN_ROWS), doc_id, text).where(F.octet_length("_t") > 0)
    size, draw = F.octet_length("_t").cast("long").alias("_size"), F.xxhash64("_label_id", F.lit(3)).alias("_draw")
    found = rows.select("_label_id", "_y", size, draw).collect()  # about TRAIN_ROWS
    kept, total = [], 0
    for x in sorted(found, key=lambda x: (x["_size"] > TRAIN_BYTES, x["_size"] if x["_size"] > TRAIN_BYTES else 0, x["_draw"])):
        if total < TRAIN_BYTES or len({k["_y"] > 0 for k in kept}) < 2 and (x["_y"] > 0) not in {k["_y"] > 0 for k in kept}:  # one of either label at least
            kept.append(x)
            total += x["_size"]
    chosen = documents.sparkSession.createDataFrame([(x["_label_id"],) for x in kept], StructType([rows.schema["_label_id"]]))
    got = rows.join(F.broadcast(chosen), "_label_id").select("_y", F.col("_t").cast("binary").alias("_t")).collect()
    return sorted((int(r["_y"] > 0), bytes(r["_t"])) for r in got)


def train(documents: DataFrame, labels: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the label rows that `learn_from` chooses and the documents of their ids."""
    model = learn(training_sample(documents, labels, learn_from, doc_id, text, label))
    release_memory()  # the driver's: what comes after the training has it
    return model


def apply(documents: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), text: str = "text", threshold: float = 0.5) -> DataFrame:
    """`carry` columns, score, predicted for every row: the worst of all overlapping windows of the whole text decides.

    Null texts count as empty; texts without words get the lowest score; a model of one kind of label gives all rows one score.
    Repeated rows get the same score; an empty table gives none; carried columns may have any name and type.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = shared.value.score(*flat_bytes(batch.column("_text")))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], names=[*batch.schema.names[:-1], "_score", "_predicted"])

    rows = documents.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(carry)], F.col(text).alias("_t"))
    out = map_texts(rows, "_t", [f"_k{i}" for i in range(len(carry))], run, "_score double, _predicted int")
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(carry)], F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))

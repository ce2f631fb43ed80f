"""Token counts by a map-side two-tier lookup of pre-token lengths (operator 7)."""

from __future__ import annotations

import re
from collections import Counter

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_texts

MODEL = "piece_bpe_32k.model"
#: Rows sampled over all partitions for the frequent tier, its entries, and a worker's cache entries. They bound memory; no count depends on them.
SAMPLE_ROWS, FREQUENT, CACHE = 2000, 50_000, 300_000
#: No piece has a space after another character, so merges never cross such a place: a text is these runs, counted apart.
_PRETOKEN = re.compile(" *[^ ]+| +$")
_LONGEST_KEPT = 64


def _load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def pre_tokens(text: str) -> list[str]:
    """The runs of a non-empty text with the prefix space that the model adds; U+2581 is the model's own space."""
    if "▁" in text:
        text = text.replace("▁", " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return _PRETOKEN.findall(" " + text)
    return [" " + w for w in text.split(" ")]


def encode_length(model, run: str) -> int:
    return len(model.encode(run[1:])) if len(run) > 1 else 1


class Counts:
    """A worker's two tiers: the broadcast table, then its own cache of what it had to encode (cleared when full)."""

    def __init__(self, frequent: dict[str, int], path: str, cache: int = CACHE):
        self.frequent, self.path, self.size, self.model, self.own = frequent, path, cache, None, {}

    def miss(self, run: str) -> int:
        n = self.own.get(run)
        if n is None:
            self.model = self.model or _load(self.path)
            n = encode_length(self.model, run)
            if len(run) <= _LONGEST_KEPT:
                if len(self.own) >= self.size:
                    self.own.clear()
                self.own[run] = n
        return n

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        get, miss, total = self.frequent.get, self.miss, 0
        for run in pre_tokens(text):
            n = get(run)
            total += miss(run) if n is None else n
        return total


_WORKER: dict[tuple[str, int], Counts] = {}


def worker_counts(path: str, shared) -> Counts:
    """The counts of this worker process, kept from task to task."""
    key = (path, len(shared.value))
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Counts(shared.value, path)
    return _WORKER[key]


def frequent_lengths(documents: DataFrame, text: str, path: str, rows: int = SAMPLE_ROWS, entries: int = FREQUENT) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of about `rows` documents, drawn from all partitions; of a long one, its first 16 KB."""
    n = documents.count()
    drawn = documents.select(F.substring(F.col(text), 1, 16384).alias("t")).sample(min(1.0, rows / max(n, 1)), seed=7).where("t != ''")
    seen: Counter[str] = Counter()
    for row in drawn.collect():  # about `rows` texts of 16 KB at most
        seen.update(pre_tokens(row.t))
    model = _load(path)
    return {run: encode_length(model, run) for run, _ in seen.most_common(entries) if len(run) <= _LONGEST_KEPT}


def count_tokens(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for every row, repeated rows included.

    Null and empty texts have no bytes and no tokens. No pre-token is shuffled: there is no exchange at all.
    """
    path = path or public_tokenizers.path(MODEL)
    shared = documents.sparkSession.sparkContext.broadcast(frequent_lengths(documents, text, path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = worker_counts(path, shared)
        raw = batch.column("_text").to_pylist()
        tokens = [counts.of(x.decode("utf-8", "replace") if x else None) for x in raw]
        sizes = [len(x) if x else 0 for x in raw]
        return pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["_id", "n_bytes", "n_tokens", "over_limit"])

    out = map_texts(documents.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")), "_t", ["_id"], run, "n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("_id", doc_id)

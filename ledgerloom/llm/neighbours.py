"""Exact nearest neighbours by a block matrix join over int8 tiles with quantisation error bounds (operator 9)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import release_memory, small_batches

#: Rows of a candidate and of a query tile of a product; bytes of a tile as it is shuffled.
TILE_ROWS, TILE_QUERIES, TILE_BYTES = 2048, 512, 256 << 10
#: Bytes of query vectors (as doubles) that a cell of the block matrix holds, and of candidates that pass by it.
QUERY_BYTES, CANDIDATE_BYTES = 32 << 20, 64 << 20
#: Candidates for each of which there is one column of cells, while these are fewer than SPREAD: small tables use all cores.
SPREAD_ROWS, SPREAD = 4096, 64
#: Above so many dimensions int8 products no longer add up exactly in float32.
_EXACT_FLOAT32 = 1040


def usable(vector: Column) -> Column:
    """Not null, every component a finite number, and one of them not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


class Block:
    """Vectors of one length with their int8 form: unit vector = scale * code + error, and the norms of both terms."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        top = np.abs(vectors).max(axis=1, keepdims=True)
        vectors = np.where((top < 1e-140) | (top > 1e140), vectors / top, vectors)  # else squares would leave the range of doubles
        self.vectors = vectors
        self.square = np.zeros(len(vectors))
        for j in range(vectors.shape[1]):
            self.square += vectors[:, j] * vectors[:, j]
        unit = vectors / np.sqrt(self.square)[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        codes = np.rint(unit / self.scale[:, None])
        coded = codes * self.scale[:, None]
        self.coded_norm = np.sqrt((coded * coded).sum(axis=1))
        self.error = np.sqrt(((unit - coded) ** 2).sum(axis=1))
        self.codes = codes.astype(np.int8)

    def tile(self) -> np.ndarray:
        return self.codes.astype(np.float32 if self.codes.shape[1] <= _EXACT_FLOAT32 else np.float64)


def cosines(a: Block, i: np.ndarray, b: Block, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs in doubles, every sum taken in the order of the components."""
    dot = np.zeros(len(i))
    for d in range(a.vectors.shape[1]):
        dot += a.vectors[i, d] * b.vectors[j, d]
    return dot / np.sqrt(a.square[i] * b.square[j])


def search_tile(queries: Block, found: list[list[tuple[float, int]]], candidates: Block, k: int) -> None:
    """Offer a candidate tile to the heaps of the queries; a pair is scored only if its upper bound can reach the k best.

    Ids are counted, not rows: a heap has one entry an id, its best so far, and of a tile's lower bounds the largest of each id counts.
    """
    right = candidates.tile()
    order = np.argsort(candidates.ids, kind="stable")
    first = np.flatnonzero(np.diff(candidates.ids[order], prepend=candidates.ids[order[0]] - 1))
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    for at in range(0, len(queries.ids), TILE_QUERIES):
        part = slice(at, at + TILE_QUERIES)
        left = queries.codes[part].astype(right.dtype)
        near = (left @ right.T).astype(np.float64) * queries.scale[part, None] * candidates.scale[None, :]
        slack = queries.error[part, None] * candidates.coded_norm[None, :] + candidates.error[None, :] + 1e-9
        own = queries.ids[part, None] == candidates.ids[None, :]
        low = np.where(own, -np.inf, near - slack)
        reach = np.array([h[0][0] if len(h) == k else -np.inf for h in found[part]])
        repeated = len(first) < len(order)
        best = np.maximum.reduceat(low[:, order], first, axis=1) if repeated else low
        if len(first) >= k:
            reach = np.maximum(reach, np.partition(best, len(first) - k, axis=1)[:, -k] - 1e-9)
        least = np.maximum(reach[:, None], best[:, group] - 1e-9) if repeated else reach[:, None]
        i, j = np.nonzero((near + slack >= least) & ~own)
        for q, score, other in _best(i + at, cosines(queries, i + at, candidates, j), candidates.ids[j], k):
            heap, item = found[q], (score, -other)
            if len(heap) == k and item <= heap[0]:
                continue
            at_id = next((x for x, h in enumerate(heap) if h[1] == -other), None)
            if at_id is not None:
                if item > heap[at_id]:
                    heap[at_id] = item
                    heapq.heapify(heap)
            elif len(heap) < k:
                heapq.heappush(heap, item)
            else:
                heapq.heapreplace(heap, item)


def _best(query: np.ndarray, score: np.ndarray, other: np.ndarray, k: int) -> Iterator[tuple[int, float, int]]:
    """Of each query's scored pairs the k best of different ids, ties to the smaller id."""
    order = np.lexsort((-score, other, query))
    query, score, other = query[order], score[order], other[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (other[1:] != other[:-1])
    query, score, other = query[new], score[new], other[new]
    order = np.lexsort((other, -score, query))
    query, score, other = query[order], score[order], other[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return zip(query[rank < k].tolist(), score[rank < k].tolist(), other[rank < k].tolist(), strict=True)


def _tiles(rows: DataFrame) -> DataFrame:
    """(_len, _rows, _tile) of rows (_id, _v): vectors of one length, packed by each task as ids and then doubles, up to TILE_BYTES."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def tile(n: int) -> pa.RecordBatch:
            parts = held.pop(n)
            ids, values = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes() + values.tobytes()], pa.binary())], names=["_len", "_rows", "_tile"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1)
            lengths, flat = vectors.value_lengths().to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(lengths) - lengths
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                step = max(1, TILE_BYTES // (8 * n))
                for lo in range(0, len(at), step):
                    part = at[lo : lo + step]
                    if n in held and sum(len(x) for x, _ in held[n]) + len(part) > step:
                        yield tile(n)
                    held.setdefault(n, []).append((ids[part], flat[starts[part, None] + np.arange(n)[None, :]]))
        for n in list(held):
            yield tile(n)
        release_memory()

    return rows.mapInArrow(pack, "_len int, _rows int, _tile binary")


def _unpacked(n: int, tiles: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ids, values = [], []
    for tile in tiles:
        rows = len(tile) // (8 * (n + 1))
        ids.append(np.frombuffer(tile, np.int64, rows))
        values.append(np.frombuffer(tile, np.float64, rows * n, 8 * rows).reshape(rows, n))
    ids, values = np.concatenate(ids), np.concatenate(values)
    if len(np.unique(ids)) < len(ids):  # equal rows of one id offer nothing more
        keep = np.sort(np.unique(np.column_stack([ids[:, None].view(np.float64), values]).view(np.int64), axis=0, return_index=True)[1])
        ids, values = ids[keep], values[keep]
    return ids, values


def _search_cells(k: int):
    """Over the tiles of whole cells, the queries of a cell first: (query_id, vec_id, score) of the k best in the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, queries, found, waiting = None, [], None, [], []

        def search() -> None:
            nonlocal queries, found, waiting
            if queries is None and asked:
                queries = Block(*_unpacked(cell[0], asked))
                found = [[] for _ in queries.ids]
            if queries is not None and waiting:
                search_tile(queries, found, Block(*_unpacked(cell[0], waiting)), k)
            waiting = []

        def result() -> Iterator[pa.RecordBatch]:
            search()
            out = [(q, -other, score) for q, heap in zip(queries.ids.tolist() if queries is not None else (), found, strict=True) for score, other in heap]
            if out:
                q, other, score = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(other, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for *key, is_candidate, rows, tile in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != cell:
                    if cell is not None:
                        yield from result()
                    cell, asked, queries, found, waiting = key, [], None, [], []
                if not is_candidate:
                    asked.append(tile)
                    continue
                waiting.append(tile)
                if sum(map(len, waiting)) >= 8 * (cell[0] + 1) * TILE_ROWS:
                    search()
        if cell is not None:
            yield from result()
        release_memory()

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of largest cosine of each query, ties to the smaller id.

    Candidates are all rows with another id. Vectors that are null, zero or hold null or non-finite components take no part,
    nor do rows without an id; vectors of different lengths are never compared; rows that repeat an id offer their best cosine
    (of a repeated query's vectors, the least is taken). An empty table gives no rows; other columns are not read.

    Both sides are packed into tiles, and the tiles dealt over the cells of a block matrix: a query tile goes to all cells of its row, a
    candidate tile to all of its column. A task holds a cell's queries and sees its candidates tile by tile; nothing is broadcast or
    collected. Each cell hands on k rows per query.
    """
    spark = vectors.sparkSession
    named = lambda df: df.select(F.col(vec_id).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v")).where(F.col("_id").isNotNull() & usable(F.col("_v")))
    slim = named(vectors)
    asked = named(vectors.where(is_query)).groupBy("_id").agg(F.min("_v").alias("_v"))
    count = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("_v")), F.lit(0)).alias("d")).first()
    of_queries, of_all = count(named(vectors.where(is_query))), count(slim)
    rows = max(1, -(-of_queries.d * 8 // QUERY_BYTES))
    columns = max(1, -(-of_all.d * 8 // CANDIDATE_BYTES), min(SPREAD, -(-of_all.n // SPREAD_ROWS)))
    small_batches(spark)
    dealt = F.xxhash64("_tile")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = _tiles(asked).select("_len", F.pmod(dealt, F.lit(rows)).cast("int").alias("_i"), everywhere(columns).alias("_j"), F.lit(0).alias("_side"), "_rows", "_tile")
    right = _tiles(slim).select("_len", everywhere(rows).alias("_i"), F.pmod(dealt, F.lit(columns)).cast("int").alias("_j"), F.lit(1).alias("_side"), "_rows", "_tile")
    cells = left.unionByName(right).repartition("_len", "_i", "_j").sortWithinPartitions("_len", "_i", "_j", "_side")
    found = cells.mapInArrow(_search_cells(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

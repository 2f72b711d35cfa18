"""Exact top-k search by inner product with vector-approximation files.

Every component is quantised into one of `CELLS` equal cells between the least and the largest value of its dimension
in the whole table, and kept as a byte.  A block of vectors holds the bytes and the exact vectors; queries stream
through it.  For a batch of queries, one product in single precision over the bytes gives the score of each vector's
cell centre; the true score lies within a distance of it that depends on the query alone, so a vector's bounds are
known without reading it.  Exact vectors are read only where the upper bound reaches the k-th best: first the best by
their bounds, then those whose bound still reaches the k-th exact score among these.  From tile to tile of the block
the k-th exact score rises, and fewer are read.

Scale: each vector is shipped once, to its block; the queries go to every block (a stated query set against all rows).
A block is bounded by its bytes, a batch of queries and a tile by their rows, and a block answers a query with k + 1
rows at most, so memory does not follow the table.  The answers of the blocks are merged by a ranked window, which
keeps k + 1 rows of a query on the map side.  Equal vectors are searched once: each carries its k + 1 least ids, and
the answer to a vector is computed once for all queries that have it; so copies, though they be a third of the table,
meet in no task.  Nothing is broadcast but the cells' borders (two numbers a dimension).

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as
padded with zeros, and so do empty ones; scores tie to the smaller id, null ids last; a query's own row is no
candidate, but a repeated row is; with no queries or no vectors the result is empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import Tables

LAST = np.iinfo(np.int64).max  # stands for a null id
CELLS = 256


@dataclass(frozen=True)
class Search:
    block_bytes: int = 32 << 20  # of exact vectors in a block
    least_blocks: int = 16
    tile: int = 8192  # vectors a product reads
    batch: int = 256  # queries a product asks for
    groups: int = 4  # in the first tile, groups of vectors for each result, whose maxima give the first floor


def matrix(col: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors of a list column, padded with zeros."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    lens = np.asarray(arr.value_lengths()).astype(np.int64)
    flat = np.asarray(arr.flatten()).astype(np.float64)
    if len(lens) and (lens == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lens), width))
    rows = np.repeat(np.arange(len(lens)), lens)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def exact(q: np.ndarray, x: np.ndarray, integer: bool) -> np.ndarray:
    """Inner products row by row; whole numbers beyond 2**53 are computed as such and then rounded once."""
    if integer and len(x) and float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1]) >= 2.0**53:
        return np.array([float(sum(int(a) * int(b) for a, b in zip(u, v, strict=True))) for u, v in zip(q, x, strict=True)])
    return np.einsum("ij,ij->i", q, x)


@dataclass(frozen=True)
class Grid:
    """The cells of each dimension: cell c is [low + c * step, low + (c + 1) * step]."""

    low: np.ndarray
    step: np.ndarray  # 0 where a dimension has one value only

    @classmethod
    def over(cls, low: np.ndarray, high: np.ndarray) -> Grid:
        return cls(low, high / CELLS - low / CELLS)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """(vectors, dimensions) bytes."""
        step = np.where(self.step > 0, self.step, 1.0)
        return np.clip((x - self.low) / step, 0, CELLS - 1).astype(np.uint8)

    def ask(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For queries: weights of the cells (single precision), how far a score may lie from its cell's, and factor and shift from the scores of the cells to true ones."""
        w = q * self.step
        factor = np.abs(w).max(1, initial=0)
        w = w / np.where(factor > 0, factor, 1.0)[:, None]
        size = np.abs(w).sum(1)
        ends = np.maximum(np.abs(self.low), np.abs(self.low + CELLS * self.step))
        # half a cell; the rounding of single precision; that of double precision in borders and scores
        fine = 8 * max(1, q.shape[1]) * 2.0**-52 * (np.abs(q) @ ends) / np.where(factor > 0, factor, 1.0)
        far = 0.5 * size * (1 + 1e-6) + (q.shape[1] + 2) * 2.0**-23 * CELLS * size + fine
        return w.astype(np.float32), far, factor, q @ (self.low + 0.5 * self.step)


def bounds(grid: Grid, cells: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (queries, vectors) of the inner products, from the cells alone."""
    w, far, factor, shift = grid.ask(q)
    middle = w @ cells.astype(np.float32).T
    back = lambda s: factor[:, None] * s + shift[:, None]
    return back(middle - far[:, None]), back(middle + far[:, None])


def _first(query: np.ndarray, score: np.ndarray, ident: np.ndarray, most: int) -> np.ndarray:
    """The places of each query's `most` best by score, ties by ident; queries in order."""
    order = np.lexsort((ident, -score, query))
    q = query[order]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[rank < most]


class Block:
    """One block: bytes and exact vectors.  `least` is each vector's least id, for ties."""

    def __init__(self, x: np.ndarray, least: np.ndarray, grid: Grid, how: Search = Search()) -> None:
        self.x, self.least, self.grid, self.how = x, least, grid, how
        self.cells = grid.cells(x)
        self.reads = 0  # exact vectors read so far

    def search(self, q: np.ndarray, most: int, integer: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, score) of each query's `most` best, by score and least id."""
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i in range(0, len(q), self.how.batch):
            a, b, c = self._batch(q[i : i + self.how.batch], most, integer)
            found.append((a + i, b, c))
        return tuple(np.concatenate([f[k] for f in found]) for k in range(3))  # type: ignore[return-value]

    def _batch(self, q: np.ndarray, most: int, integer: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, far, factor, shift = self.grid.ask(q)
        floor = np.full(len(q), -np.inf)  # of the scores of cells
        best: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for i in range(0, len(self.x), self.how.tile):
            s = w @ self.cells[i : i + self.how.tile].astype(np.float32).T
            if not i:
                floor = self._floor(s, most) - 2 * far
            at = np.flatnonzero(s >= floor.astype(np.float32)[:, None])
            query, vector, score = at // s.shape[1], at % s.shape[1], s.ravel()[at]
            # the best by their bounds first, then what may still reach the k-th of them
            near = np.zeros(len(at), bool)
            near[_first(query, score, vector, most)] = True
            got = [self._read(q, query[near], vector[near] + i, integer)]
            floor = np.maximum(floor, self._known(*got[0], len(q), most, far, factor, shift))
            later = ~near & (score >= floor[query])
            got.append(self._read(q, query[later], vector[later] + i, integer))
            whole = [np.concatenate([best[k], got[0][k], got[1][k]]) for k in range(3)]
            keep = _first(whole[0], whole[2], self.least[whole[1]], most)
            best = tuple(v[keep] for v in whole)
            floor = np.maximum(floor, self._known(*best, len(q), most, far, factor, shift))
        return best  # type: ignore[return-value]

    def _floor(self, s: np.ndarray, most: int) -> np.ndarray:
        """A score that `most` vectors reach: the `most`-th best of the maxima of groups of vectors."""
        parts = self.how.groups * most
        if s.shape[1] <= most:
            return np.full(len(s), -np.inf)
        if s.shape[1] < 2 * parts:
            return np.partition(s, -most, axis=1)[:, -most].astype(np.float64)
        size = s.shape[1] // parts
        tops = s[:, : size * parts].reshape(len(s), size, parts).max(1)
        return np.partition(tops, -most, axis=1)[:, -most].astype(np.float64)

    def _read(self, q: np.ndarray, query: np.ndarray, vector: np.ndarray, integer: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The exact scores of pairs, a bounded number of them at once."""
        self.reads += len(query)
        step = max(1, (8 << 20) // (8 * max(1, q.shape[1])))
        score = [exact(q[query[i : i + step]], self.x[vector[i : i + step]], integer) for i in range(0, len(query), step)]
        return query, vector, np.concatenate([np.zeros(0), *score])

    @staticmethod
    def _known(query: np.ndarray, vector: np.ndarray, score: np.ndarray, n: int, most: int, far: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """For each query the least score of a cell whose vectors may reach its `most`-th exact score; none if there are fewer."""
        out = np.full(n, -np.inf)
        order = np.lexsort((-score, query))
        q = query[order]
        start = np.searchsorted(q, np.arange(n))
        full = np.flatnonzero(np.bincount(q, minlength=n) >= most)
        kth = score[order[start[full] + most - 1]]
        with np.errstate(all="ignore"):
            at = (kth - shift[full]) / factor[full] - far[full]
        at = at - 1e-6 * np.abs(at)  # compared in single precision
        out[full] = np.where(np.isfinite(at), at, -np.inf)
        return out


HITS = "q1 bigint, q2 bigint, score double, least bigint, ids array<bigint>, copies array<bigint>"


def _scan(width: int, grid: Grid, most: int, integer: bool, how: Search):
    """Reads the rows of a block, its vectors before the queries, and yields hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        block, ids, copies = None, None, None
        for batch in batches:
            asks = np.asarray(batch["asks"].fill_null(False)).astype(bool)
            if not asks.all():
                part = batch.filter(pa.array(~asks))
                held.append((matrix(part["vector"], width), part["ids"], part["copies"]))
            if not asks.any() or not held:
                continue
            if block is None:
                ids, copies = (pa.concat_arrays([h[k] for h in held]) for k in (1, 2))
                first = np.asarray(ids.offsets)[:-1]
                block = Block(np.concatenate([h[0] for h in held]), np.asarray(ids.values)[first], grid, how)
                held = held[:1]
            part = batch.filter(pa.array(asks))
            query, vector, score = block.search(matrix(part["vector"], width), most, integer)
            for i in range(0, len(query), 65536):
                at, v = pa.array(query[i : i + 65536]), pa.array(vector[i : i + 65536])
                cols = [part["k1"].take(at), part["k2"].take(at), pa.array(score[i : i + 65536]), pa.array(block.least[vector[i : i + 65536]]), ids.take(v), copies.take(v)]
                yield pa.RecordBatch.from_arrays(cols, ["q1", "q2", "score", "least", "ids", "copies"])

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's vectors: for each dimension its extremes and how many vectors have it; as dimension -1, how many there are."""
    low, high, count, rows = np.zeros(0), np.zeros(0), np.zeros(0, np.int64), 0
    for batch in batches:
        lens = np.asarray(batch["vector"].value_lengths()).astype(np.int64)
        if not len(lens):
            continue
        width, rows = max(len(low), int(lens.max())), rows + len(lens)
        x = matrix(batch["vector"], width)
        real = np.arange(width) < lens[:, None]
        pad = lambda v, fill: np.append(v, np.full(width - len(v), fill, v.dtype))
        low = np.minimum(pad(low, np.inf), np.where(real, x, np.inf).min(0))
        high = np.maximum(pad(high, -np.inf), np.where(real, x, -np.inf).max(0))
        count = pad(count, 0) + real.sum(0)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(low)), pa.int32()), pa.array(np.append(0.0, low)), pa.array(np.append(0.0, high)), pa.array(np.append(rows, count))], ["dim", "low", "high", "n"])


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, integer: bool = False, how: Search = Search()) -> DataFrame:
    """(query_id, rank, <id_col>, score) of each query's `k` best other rows; `is_query` reads the column `id`.

    With `integer`, components are whole numbers and scores are bigint.
    """
    tables, most = Tables(vectors.sparkSession), k + 1  # one more: the own row may be among them
    x = F.col("vector")
    usable = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda v: v + 0.0).alias("vector"))
    rows = rows.where(F.coalesce(usable, F.lit(False))).select(F.xxhash64(F.lit(1), "vector").alias("k1"), F.xxhash64(F.lit(2), "vector").alias("k2"), "id", "vector", F.coalesce(is_query, F.lit(False)).alias("is_query"))
    same = ["k1", "k2"]
    # the ids of each vector: copies of a row are counted, then the least ids of a vector are found on the map side first
    members = tables.cut(rows.groupBy(*same, "id", "is_query").agg(F.count("*").alias("copies")))
    by_id = Window.partitionBy(*same).orderBy(F.col("id").asc_nulls_last(), "is_query")
    least = members.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= most)
    listed = F.sort_array(F.collect_list(F.struct("r", F.coalesce("id", F.lit(int(LAST))).alias("id"), "copies")))
    named = least.groupBy(*same).agg(listed.alias("m")).select(*same, F.col("m.id").alias("ids"), F.col("m.copies").alias("copies"))
    asked = members.where("is_query").select(*same).distinct()
    one = rows.groupBy(*same).agg(F.first("vector").alias("vector"))
    file = tables.cut(one.join(named, same).join(asked.withColumn("is_query", F.lit(True)), same, "left").select(*same, "vector", "ids", "copies", F.coalesce("is_query", F.lit(False)).alias("is_query")))
    # the cells' borders: a row for each dimension
    of_dim = file.select("vector").mapInArrow(_ranges, "dim int, low double, high double, n bigint").groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    found = {r.dim: r for r in of_dim.collect()}
    n, width = found[-1].n if found else 0, max(found, default=-1) + 1
    padded = [found[d].n < n for d in range(width)]
    low = np.array([min(found[d].low, 0.0) if padded[d] else found[d].low for d in range(width)])
    high = np.array([max(found[d].high, 0.0) if padded[d] else found[d].high for d in range(width)])
    blocks = max(how.least_blocks, -(-n * max(1, width) * 8 // how.block_bytes))
    # vectors to their block, queries to every block
    place = F.pmod(F.xxhash64(*same, F.lit(3)), F.lit(blocks)).cast("int")
    data = file.select(place.alias("block"), F.lit(False).alias("asks"), *same, "vector", "ids", "copies")
    nothing = F.lit(None).cast("array<bigint>")
    asks = file.where("is_query").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), *same, "vector", nothing.alias("ids"), nothing.alias("copies"))
    dealt = data.unionByName(asks).repartitionById(int(blocks), "block").sortWithinPartitions("block", "asks")
    hits = dealt.select("asks", *same, "vector", "ids", "copies").mapInArrow(_scan(width, Grid.over(low, high), most, integer, how), HITS)
    # the blocks' answers: the best vectors, then the best rows
    asker = ["q1", "q2"]
    by_score = Window.partitionBy(*asker).orderBy(F.desc("score"), "least")
    top = hits.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= most)
    each = F.explode(F.flatten(F.transform(F.arrays_zip("ids", "copies"), lambda m: F.array_repeat(m.ids, F.least(m.copies, F.lit(most)).cast("int")))))
    by_row = Window.partitionBy(*asker).orderBy(F.desc("score"), "id")
    ranked = top.select(*asker, "score", each.alias("id")).withColumn("r", F.row_number().over(by_row)).where(F.col("r") <= most)
    answers = ranked.groupBy(*asker).agg(F.sort_array(F.collect_list(F.struct("r", "score", "id"))).alias("best"))
    # each query row takes its vector's answer but for itself
    queries = members.where("is_query").select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("id").alias("query_id"), "copies")
    own = F.coalesce("query_id", F.lit(int(LAST)))
    joined = queries.join(answers, asker).withColumn("own", F.array_position(F.col("best.id"), own))
    others = F.when(F.col("own") > 0, F.filter("best", lambda h: h.r != F.col("own"))).otherwise(F.col("best"))
    out = joined.select("query_id", F.slice(others, 1, k).alias("best"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("time")).select("query_id", F.posexplode("best").alias("rank", "hit"))
    score = F.col("hit.score").cast("long") if integer else F.col("hit.score")
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.when(F.col("hit.id") != int(LAST), F.col("hit.id")).alias(id_col), score.alias("score"))

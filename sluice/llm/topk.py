"""Exact top-k by inner product: columnar branch-and-bound over blocks of vectors.

Components become floor(scale * x). Vectors are packed into blocks in vertical layout, one row of the matrix per
dimension, and stay where they are: the stated query set goes to them, `query_bytes` of it at a time, one pass over the
blocks for each such part. A tile of queries meets a block dimension group by dimension group: the partial scores of the
vectors that are still in are accumulated, and a vector leaves when, for every query of the tile, its partial score plus
the product of the remaining masses (norms over the dimensions not seen yet) stays below the query's k-th best score so
far; the survivors are compacted before the next group. A task carries the k best of each query from block to block, and
starts from the k-th best score among the vectors of largest mass of the whole table, so bounds prune across blocks.
What is shuffled is k rows a query and task.

Vectors that are null or hold null, NaN or infinities take no part, neither as queries nor as candidates. A shorter
vector counts as if zeros followed. Ties go to the smaller id, null ids last; a null id is no query. Repeated rows are
rows of their own: a query's own row is no candidate, its twin is. Scores beyond 64 bits are cut to the nearest long.
No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import cut

#: Numbers in a packed block, queries in a tile, bytes of queries in a pass, vectors of the largest mass.
BLOCK_NUMBERS = 1 << 18
TILE = 16
QUERY_BYTES = 32 << 20
PEAKS = 256
_EXACT = 2.0**53
_LONG = (-(2**63), 2**63 - 1)


def _pack(df: DataFrame, id_col: str, vector_col: str, scale: float, block_numbers: int) -> DataFrame:
    """Rows of: block, n, dims, ids (long[n]), known (byte[n], 0 for a null id), matrix (dims x n, int16 or double)."""
    v = F.col(vector_col).cast("array<double>")
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.coalesce(good, F.lit(False)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, part = 0, TaskContext.get().partitionId()
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            flat, lengths = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            at, i = 0, 0
            while i < b.num_rows:
                step = max(1, block_numbers // max(1, int(lengths[i : i + block_numbers].max(initial=1))))
                k = lengths[i : i + step]
                dims, n = int(k.max(initial=0)), len(k)
                rowwise = np.zeros((n, dims))
                rowwise[np.arange(dims) < k[:, None]] = np.floor(flat[at : at + int(k.sum())] * scale)
                narrow = n * dims == 0 or np.abs(rowwise).max() < 2**15
                known = np.array([x.is_valid for x in ids[i : i + n]], np.uint8)
                matrix = np.ascontiguousarray(rowwise.T.astype(np.int16 if narrow else np.float64))
                yield _row(part << 32 | serial, n, dims, bool(narrow), ids[i : i + n].fill_null(0).to_numpy().astype(np.int64).tobytes(), known.tobytes(), matrix.tobytes())
                serial, at, i = serial + 1, at + int(k.sum()), i + n

    return rows.mapInArrow(work, "block long, n int, dims int, narrow boolean, ids binary, known binary, matrix binary")


def _row(block: int, n: int, dims: int, narrow: bool, ids: bytes, known: bytes, matrix: bytes) -> pa.RecordBatch:
    names = ["block", "n", "dims", "narrow", "ids", "known", "matrix"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((block, n, dims, narrow, ids, known, matrix), kinds, strict=True)], names)


def _matrix(raw: bytes, narrow: bool, dims: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.int16 if narrow else np.float64).reshape(dims, n).astype(np.float64)


def _queries(blocks: DataFrame, every: int) -> DataFrame:
    """block, pos, id, vector (double bytes) of the rows that are queries."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, known = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["known"], np.uint8)
                pos = np.nonzero((ids % every == 0) & (known == 1))[0]
                m = np.ascontiguousarray(_matrix(r["matrix"], r["narrow"], r["dims"], r["n"])[:, pos].T)
                vectors = pa.array([x.tobytes() for x in m], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), r["block"])), pa.array(pos.astype(np.int32)), pa.array(ids[pos]), vectors], ["block", "pos", "id", "vector"])

    return blocks.mapInArrow(work, "block long, pos int, id long, vector binary")


def _long(x: int) -> int:
    return min(max(x, _LONG[0]), _LONG[1])


def best_in_block(queries: np.ndarray, own: np.ndarray, matrix: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int, group: int | None = None, floors: np.ndarray | None = None, trace: list | None = None) -> Iterator[tuple[int, int, int]]:
    """(query, column, score) of each query's k best columns of a dims x n matrix; own: the column to leave out, or -1.

    queries: rows x dims. Ties go to known ids, then smaller ids, then smaller columns. floors: scores that columns must
    reach to be of use. trace: gets the columns still in after each group.
    """
    dims, n = matrix.shape
    if not n:
        return
    order = np.lexsort((np.arange(n), ids, 1 - known))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    peak = float(np.abs(queries).max(initial=0)) * float(np.abs(matrix).max(initial=0)) * max(1, dims)
    if peak >= _EXACT:  # doubles would round: exact integers instead, without bounds
        q, c = queries.astype(object), matrix.astype(object)
        for i, row in enumerate(q):
            scores = [_long(int(sum(int(a) * int(b) for a, b in zip(row, c[:, j], strict=True)))) for j in range(n)]
            for j in sorted((j for j in range(n) if j != own[i]), key=lambda j: (-scores[j], rank[j]))[:k]:
                yield i, j, scores[j]
        return
    group = group or max(1, dims // 8)
    cuts = list(range(0, dims, group))
    mass_c = [np.sqrt((matrix[at:] ** 2).sum(0)) for at in [*cuts, dims]]
    mass_q = [np.sqrt((queries[:, at:] ** 2).sum(1)) for at in [*cuts, dims]]
    for t in range(0, len(queries), TILE):
        q, mine = queries[t : t + TILE], own[t : t + TILE]
        # the columns of the largest mass give the first k-th best scores
        seed = np.argsort(-mass_c[0], kind="stable")[: 8 * k + 8]
        floor = _kth(q @ matrix[:, seed], mine[:, None] == seed, k)
        if floors is not None:
            floor = np.maximum(floor, floors[t : t + TILE])
        alive, block = np.arange(n), matrix
        partial = np.zeros((len(q), n))
        for g, at in enumerate(cuts):
            partial += q[:, at : at + group] @ block[at : at + group]
            reach = mass_q[g + 1][t : t + TILE, None] * mass_c[g + 1][alive]
            stay = (partial + reach * (1 + 1e-9) + 1e-6 >= floor[:, None]).any(0)
            if not stay.all():
                alive, partial, block = alive[stay], partial[:, stay], np.ascontiguousarray(block[:, stay])
            if trace is not None:
                trace.append(len(alive))
        for i in range(len(q)):
            ok = np.nonzero((partial[i] >= floor[i]) & (alive != mine[i]))[0]
            for j in ok[np.lexsort((rank[alive[ok]], -partial[i][ok]))[:k]]:
                yield t + i, int(alive[j]), int(partial[i][j])


def _kth(scores: np.ndarray, not_these: np.ndarray, k: int) -> np.ndarray:
    """Per row the k-th largest score, without some; minus infinity if there are not so many."""
    scores = np.where(not_these, -np.inf, scores)
    return np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(scores), -np.inf)


@dataclass(frozen=True)
class Asked:
    """Queries of a pass: places (block, pos), ids, vectors (rows), and the places and vectors of the largest mass."""

    block: np.ndarray
    pos: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    peak_block: np.ndarray
    peak_pos: np.ndarray
    peaks: np.ndarray

    def floors(self, k: int) -> np.ndarray:
        """Scores that a query's k-th best reaches at least; none where doubles would round."""
        none = np.full(len(self.ids), -np.inf)
        dims = min(self.vectors.shape[1], self.peaks.shape[1])
        q, c = self.vectors[:, :dims], self.peaks[:, :dims]
        if not dims or float(np.abs(self.vectors).max(initial=0)) * float(np.abs(self.peaks).max(initial=0)) * dims >= _EXACT:
            return none
        own = (self.block[:, None] == self.peak_block) & (self.pos[:, None] == self.peak_pos)
        return _kth(q @ c.T, own, k)


def _padded(vectors: list[bytes]) -> np.ndarray:
    rows = [np.frombuffer(v) for v in vectors]
    dims = max(map(len, rows), default=0)
    return np.array([np.pad(v, (0, dims - len(v))) for v in rows]).reshape(len(rows), dims)


def _peaks(blocks: DataFrame, n: int) -> list:
    """block, pos, vector of the n vectors of largest mass; every block names n at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                m = _matrix(r["matrix"], r["narrow"], r["dims"], r["n"])
                mass = (m**2).sum(0)
                pos = np.argsort(-mass, kind="stable")[:n]
                vectors = pa.array([np.ascontiguousarray(m[:, p]).tobytes() for p in pos], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), r["block"])), pa.array(pos.astype(np.int32)), pa.array(mass[pos]), vectors], ["block", "pos", "mass", "vector"])

    found = blocks.mapInArrow(work, "block long, pos int, mass double, vector binary")
    return found.orderBy(F.col("mass").desc(), "block", "pos").limit(n).collect()


def _best(asked: Broadcast, k: int) -> Callable:
    """mapInArrow function: of a task's blocks the k best columns for each query."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: Asked = asked.value
        floors = a.floors(k)
        none = np.zeros(0, np.int64)
        best = [none] * 6  # query, score, unknown (1 for a null id), id, block, pos; k rows a query at most
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                ids, known = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["known"], np.uint8)
                dims = max(r["dims"], a.vectors.shape[1])
                q = np.pad(a.vectors, ((0, 0), (0, dims - a.vectors.shape[1])))
                m = np.pad(_matrix(r["matrix"], r["narrow"], r["dims"], r["n"]), ((0, dims - r["dims"]), (0, 0)))
                own = np.where(a.block == r["block"], a.pos, -1)
                found = np.array(list(best_in_block(q, own, m, ids, known, k, floors=floors)), np.int64).reshape(-1, 3)
                new = [found[:, 0], found[:, 2], 1 - known[found[:, 1]].astype(np.int64), ids[found[:, 1]], np.full(len(found), r["block"], np.int64), found[:, 1]]
                rows = [np.concatenate(x) for x in zip(best, new, strict=True)]
                order = np.lexsort((rows[5], rows[4], rows[3], rows[2], -rows[1].astype(np.float64), rows[0])) if len(rows[0]) else none
                order = _exactly(order, rows)
                first = np.searchsorted(rows[0][order], rows[0][order])
                place = np.arange(len(order)) - first
                best = [x[order][place < k] for x in rows]
                full = order[place == k - 1]
                floors = floors.copy()
                floors[rows[0][full]] = np.maximum(floors[rows[0][full]], rows[1][full])
        at = best[0]
        ids = pa.array(best[3], pa.int64(), mask=best[2] == 1)
        yield pa.RecordBatch.from_arrays([pa.array(a.block[at]), pa.array(a.pos[at], pa.int32()), pa.array(a.ids[at]), ids, pa.array(best[4]), pa.array(best[5], pa.int32()), pa.array(best[1])], ["q_block", "q_pos", "query_id", "vec_id", "c_block", "c_pos", "score"])

    return work


def _exactly(order: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """The order of rows by query, score (falling), unknown, id, block, pos where scores are beyond a double's integers."""
    if not len(order) or np.abs(rows[1].astype(np.float64)).max() < _EXACT:
        return order
    return np.array(sorted(range(len(order)), key=lambda i: (int(rows[0][i]), -int(rows[1][i]), *(int(x[i]) for x in rows[2:]))), np.int64)


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, scale: float = 256.0, block_numbers: int = BLOCK_NUMBERS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other rows for each row whose id `every` divides."""
    spark = df.sparkSession
    blocks = cut(_pack(df, id_col, vector_col, scale, block_numbers))
    queries = cut(_queries(blocks, every))
    size = queries.agg(F.sum(F.length("vector") + 32)).first()[0] or 0
    passes = max(1, -(-int(size) // query_bytes))
    peaks = _peaks(blocks, PEAKS)
    found = spark.createDataFrame([], "q_block long, q_pos int, query_id long, vec_id long, c_block long, c_pos int, score long")
    for i in range(passes):
        rows = queries.where(F.pmod(F.xxhash64("block", "pos"), F.lit(passes)) == i).orderBy("block", "pos").collect()
        if not rows:
            continue
        number = lambda rs, name: np.array([r[name] for r in rs], np.int64)
        asked = Asked(number(rows, "block"), number(rows, "pos"), number(rows, "id"), _padded([bytes(r.vector) for r in rows]), number(peaks, "block"), number(peaks, "pos"), _padded([bytes(r.vector) for r in peaks]))
        shared = spark.sparkContext.broadcast(asked)
        found = found.unionByName(cut(blocks.mapInArrow(_best(shared, k), found.schema)) if passes > 1 else blocks.mapInArrow(_best(shared, k), found.schema))
        if passes > 1:
            shared.destroy()
    by = Window.partitionBy("q_block", "q_pos").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "c_block", "c_pos")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

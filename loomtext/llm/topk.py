"""Exact top-k inner products with block-at-a-time pruning.

Vectors are documents whose terms are the dimensions, with integer weights. Documents are cut
by ranges of their id into chunks, a few for each core but of at most ``CHUNK`` vectors and
``CHUNK_BYTES``, and a chunk into blocks of ``BLOCK`` documents; a block has each term's largest
and smallest weight and a forward index, the block's vectors. For a query, the sum of the
terms' extreme contributions bounds every score within a block.

1. The blocks' bounds alone, 2 vectors a block, meet the queries. Each query's block with the
   highest bound is scored, which gives the query a floor: its k-th score there.
2. Bounds and queries meet again, and a query goes on only to the chunks that hold a block whose
   bound reaches its floor. There blocks are ordered by bound and scored through their forward
   index until the bound falls below the k-th score found or the floor.

So vectors are never sent where nothing can be found, and only scores from the floor up leave a
chunk; the best k are merged. Where bounds say nothing, as for vectors without any structure,
each chunk meets every query, in groups of ``GROUP`` query chunks a task.

Scores are exact: in doubles while every partial sum stays below 2**53, else in integers;
beyond the range of long they saturate.

Defined results: vectors that are null or hold null or non-finite components take no part, nor
do rows with a null id. Components beyond the range of long saturate. Missing components of a
shorter vector count as 0. Rows that share an id are one document, with the smallest vector. A
query never finds its own id. Ties go to the smaller id. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import bytesvec as bv
from .scratch import materialize

K, CHUNK, LEAST, BLOCK, QUERIES = 20, 1 << 16, 2048, 256, 4096
CHUNK_BYTES, GROUP = 32 << 20, 64
#: A row of every exchange: group, order within it, number, and arrays of one kind of integer.
ROW = "g int, o int, n int, ids binary, width int, kind string, a binary, b binary"
_NAMES = [x.split()[0] for x in ROW.split(", ")]
_NO_FLOOR = np.iinfo(np.int64).min


def quantize(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as long, null where the vector takes no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & F.coalesce(fine, F.lit(False)), F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("long")))


def _small(a: np.ndarray) -> np.ndarray:
    """The same values in the smallest integers that hold them."""
    low, high = int(a.min(initial=0)), int(a.max(initial=0))
    return a.astype(next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max))


def _row(g: int, o: int, n: int, ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """One row of ``ROW``; the two arrays share a kind unless b is empty or of int64 (kind says a's)."""
    values = [[g], [o], [n], [ids.astype(np.int64).tobytes()], [a.shape[1] if a.ndim > 1 else 0], [a.dtype.str], [a.tobytes()], [b.tobytes()]]
    kinds = [pa.int32()] * 3 + [pa.binary(), pa.int32(), pa.string(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=_NAMES)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, bytes]]:
    """g, o, n, ids, a as a matrix, and b's bytes of each row, one row in memory at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            g, o, n, ids, width, kind, a, b = (c[k].as_py() for c in batch.columns)
            a = np.frombuffer(a, kind)
            yield g, o, n, np.frombuffer(ids, np.int64), a.reshape(-1, width) if width else a.reshape(len(ids) // 8, 0), b


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Chunks (part, number, ids, width, kind, a: weights) of at most ``size`` vectors and ``CHUNK_BYTES``, in ranges of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        vectors: list[np.ndarray] = []
        width = 0

        def out() -> pa.RecordBatch:
            nonlocal number, width
            weights = np.zeros((len(ids), width), np.int64)
            for i, v in enumerate(vectors):
                weights[i, : len(v)] = v
            row = _row(part, 0, number, np.array(ids, np.int64), _small(weights), np.zeros(0))
            ids.clear()
            vectors.clear()
            number, width = number + 1, 0
            return row

        for batch in batches:
            column = batch.column(1)
            cuts, flat = column.offsets.to_numpy(), column.values.to_numpy()
            for i, a, b in zip(batch.column(0).to_pylist(), cuts, cuts[1:]):
                if ids and (len(ids) >= size or 8 * max(width, b - a) * (len(ids) + 1) > CHUNK_BYTES):
                    yield out()
                ids.append(i)
                vectors.append(flat[a:b])
                width = max(width, int(b - a))
        if ids:
            yield out()

    return rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id").mapInArrow(bv.lean(run), ROW)


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """Matrices of equal width, in numbers in which their products are exact."""
    width = max(a.shape[1] for a in arrays)
    most = [float(np.abs(a.astype(float)).max(initial=0)) for a in arrays]
    bound = most[0] * max(most[1:]) * max(1, width)
    kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object
    return [np.pad(a, ((0, 0), (0, width - a.shape[1]))).astype(kind) for a in arrays]


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The most that each query can score in each block."""
    q, high, low = _exact(queries, high, low)
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


class BlockIndex:
    """A chunk of documents in blocks with bounds and forward indexes."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, block: int = BLOCK):
        self.ids, self.weights = ids, weights
        self.starts = np.arange(0, len(ids), block)
        self.ends = np.minimum(self.starts + block, len(ids))
        self.high, self.low = np.maximum.reduceat(weights, self.starts), np.minimum.reduceat(weights, self.starts)

    def floors(self, query_ids: np.ndarray, queries: np.ndarray, block: np.ndarray, k: int) -> np.ndarray:
        """Each query's k-th score in one block, ``_NO_FLOOR`` where fewer are found."""
        q, w = _exact(queries, self.weights)
        out = np.full(len(q), _NO_FLOOR)
        for b in np.unique(block):
            r = np.flatnonzero(block == b)
            s, e = self.starts[b], self.ends[b]
            score = q[r] @ w[s:e].T
            own = query_ids[r][:, None] == self.ids[None, s:e]
            if e - s >= k + own.any():
                score = np.sort(np.where(own, score.min() if len(score) else 0, score), axis=1)
                # a query's own place has the lowest of all scores, and one more is asked for
                got = score[np.arange(len(r)), e - s - k]
                out[r] = [min(max(int(x), _NO_FLOOR), 2**63 - 1) for x in got] if got.dtype == object else got.astype(np.int64)
        return out

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, score) of the k best of each query that reach its floor; the blocks visited are counted in ``visits``."""
        q, w, high, low = _exact(queries, self.weights, self.high, self.low)
        bounds, kind = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T, q.dtype
        order = np.argsort(-bounds, axis=1, kind="stable")
        n, self.visits = len(q), 0
        worst = _NO_FLOOR if kind != np.float64 else -np.inf
        floor = np.full(n, worst, kind)
        if floors is not None:
            some = floors != _NO_FLOOR
            floor[some] = floors[some].astype(kind)
        best = np.full((n, k), worst, kind)
        names = np.full((n, k), np.iinfo(np.int64).max)
        rows = np.arange(n)
        for step in range(len(self.starts)):
            block = order[:, step]
            # bounds only fall along a query's order: one below its k-th score or its floor ends it
            rows = rows[bounds[rows, block[rows]] >= np.maximum(best[rows, k - 1], floor[rows])]
            if not len(rows):
                break
            for b in np.unique(block[rows]):
                r = rows[block[rows] == b]
                self.visits += len(r)
                s, e = self.starts[b], self.ends[b]
                score = q[r] @ w[s:e].T
                score[query_ids[r][:, None] == self.ids[None, s:e]] = worst
                hit = (score >= np.maximum(best[r, k - 1], floor[r])[:, None]) & (score > worst)
                some = hit.any(1)
                if not some.any():
                    continue
                r, score, hit = r[some], score[some], hit[some]
                wide = np.concatenate((best[r], np.where(hit, score, worst)), 1)
                ids = np.concatenate((names[r], np.broadcast_to(self.ids[s:e], hit.shape)), 1)
                top = np.lexsort((ids, -wide), axis=1)[:, :k]
                best[r], names[r] = np.take_along_axis(wide, top, 1), np.take_along_axis(ids, top, 1)
        i, j = np.nonzero(best > worst)
        score = best[i, j]
        if kind == object:
            score = np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in score], np.int64)
        return i, names[i, j], score.astype(np.int64)


def _meet(*tables: DataFrame, groups: int) -> DataFrame:
    """The tables' rows by group and order, a number of groups a task."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.union(t)
    return rows.repartition(max(1, min(groups, 10_000)), "g").sortWithinPartitions("g", "o")


def search(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score of the k best documents of every query row.

    ``is_query`` is a condition on ``vec_id``.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantize(F.col(vector), scale).alias("v")).where("vec_id is not null and v is not null")
    rows = materialize(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    each = -(-rows.count() // (3 * rows.sparkSession.sparkContext.defaultParallelism))
    chunks, queries = materialize(_packed(rows, min(CHUNK, max(LEAST, each))), "chunks"), materialize(_packed(rows.where(is_query), QUERIES), "queries")

    def numbered(df: DataFrame) -> tuple[DataFrame, int]:
        """Chunks numbered in their order, a few numbers for each."""
        keys = df.select(F.col("g").alias("part"), F.col("n").alias("number")).withColumn("c", F.row_number().over(Window.orderBy("part", "number")) - 1)
        out = df.join(keys, (F.col("g") == F.col("part")) & (F.col("n") == F.col("number")))
        return out.select("c", "ids", "width", "kind", "a", "b"), df.count()

    (c, n_chunks), (q, n_queries) = numbered(chunks), numbered(queries)
    if not n_chunks or not n_queries:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    as_row = lambda df, g, o, n: df.select(g.cast("int").alias("g"), F.lit(o).alias("o"), n.cast("int").alias("n"), "ids", "width", "kind", "a", "b")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, n, ids, w, _ in _rows(batches):
            index = BlockIndex(ids, w)
            yield _row(0, 2, n, ids[:0], index.high, index.low)

    bounds = materialize(as_row(c, F.lit(0), 0, F.col("c")).mapInArrow(bv.lean(extremes), ROW), "bounds")
    to_queries = bounds.withColumn("g", every(n_queries))
    by_query = as_row(q, F.col("c"), 0, F.col("c"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To each chunk, the queries whose best block it holds: g chunk, n query chunk, a vectors, b places and blocks."""
        now = None

        def out() -> Iterator[pa.RecordBatch]:
            for x in np.unique(chunk):
                r = np.flatnonzero(chunk == x)
                yield _row(int(x), 1, now, ids[r], w[r], np.stack([r, block[r]]).astype(np.int64))

        for g, o, n, i, a, b in _rows(batches):
            if o == 0:
                if now is not None:
                    yield from out()
                now, ids, w = g, i, a
                best, chunk, block = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            else:
                # which block is tried first is a guess: doubles will do
                x = _bounds(w, a, np.frombuffer(b, a.dtype).reshape(a.shape)).astype(float)
                at = x.argmax(1)
                better = x[np.arange(len(x)), at] > best
                best[better], chunk[better], block[better] = x[np.arange(len(x)), at][better], n, at[better]
        if now is not None:
            yield from out()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Back to each query chunk, floors: g query chunk, ids places, b floors."""
        index = None
        for g, o, n, ids, w, b in _rows(batches):
            if o == 0:
                index = BlockIndex(ids, w)
            else:
                place, block = np.frombuffer(b, np.int64).reshape(2, -1)
                yield _row(n, 1, g, place, w[:0], index.floors(ids, w, block, k))

    tried = _meet(by_query, to_queries, groups=n_queries).mapInArrow(bv.lean(first), ROW)
    floors = materialize(_meet(as_row(c, F.col("c"), 0, F.col("c")), tried, groups=n_chunks).mapInArrow(bv.lean(probe), ROW), "floors")
    parts = -(-n_queries // GROUP)

    def survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To each chunk, the queries that a block of it may serve: g chunk and group of query chunks, a vectors, b floors."""
        for g, o, n, i, a, b in _rows(batches):
            if o == 0:
                ids, w, floor = i, a, np.full(len(i), _NO_FLOOR)
            elif o == 1:
                floor[i] = np.frombuffer(b, np.int64)
            else:
                x = _bounds(w, a, np.frombuffer(b, a.dtype).reshape(a.shape)).max(1)
                r = np.flatnonzero((floor == _NO_FLOOR) | (x >= floor.astype(x.dtype)))
                if len(r):
                    yield _row(n * parts + g // GROUP, 1, g, ids[r], w[r], floor[r])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for _, o, _, ids, w, b in _rows(batches):
            if o == 0:
                index = BlockIndex(ids, w)
            else:
                i, found, value = index.search(ids, w, k, np.frombuffer(b, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(found), pa.array(value)], names=["query_id", "vec_id", "score"])

    asked = _meet(by_query, floors, to_queries, groups=n_queries).mapInArrow(bv.lean(survive), ROW)
    copies = c.withColumn("s", every(parts)).withColumn("g", F.col("c") * parts + F.col("s"))
    found = _meet(as_row(copies, F.col("g"), 0, F.col("c")), asked, groups=n_chunks * parts).mapInArrow(bv.lean(score), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

"""Mixing sources to target weights in fixed-length token blocks.

Each source's words, in order of a hash bucket and then document id, are packed into blocks of
``BLOCK`` words. A source's target words become slots, one block each, and ``SHARD_SLOTS`` slots
make an output shard (the last may be smaller). How many slots of each source a shard holds is
drawn at random by the target weights: multinomial counts, given that the sources' totals are
met exactly, so that no source passes its cap by chance. Such a draw (a multivariate
hypergeometric one) is made by halving: the counts of a range of shards are dealt to its two
halves, down to single shards, each from its own seed, so tasks draw their shards independently.

A source's slot j takes block ``permutation(j mod blocks)``, a Feistel permutation keyed by
seed, source and epoch, so every epoch takes each block once; another permutation scatters a
shard's slots. Blocks are then joined by source and block number. ``shards`` gives the output,
block by block with its text, ``write_shards`` writes it.

Sources by code point, null last, weigh 1, 2, 3, repeating; they share all words. A target
stops at ``max_repeats`` times its source's words and the excess is reshared by weight until
none is above: the fixed point is found from running sums over sources by cap to weight.

Texts are read once to count words; only ids and numbers are shuffled until texts are wanted.
Word positions within a source are prefix sums over salted buckets, so no task holds a whole
source. The driver holds a few numbers for each source and range of shards. Draws and
permutations are functions of the seed, so reruns agree.

Defined results: null or empty texts have size 0 and take 0. A null source is a source.
Repeated rows and ids are packed one after the other (order: id, nulls first, size, hash of
the text). Texts may be of any length. Other columns are ignored, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import bytesvec as bv
from .scratch import fresh, materialize

BLOCK, SHARD_SLOTS, MAX_REPEATS, ROUNDS = 128, 8192, 3, 6


def word_counts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers of runs without ASCII white space, of each text."""
    starts, _ = bv.runs(bv.NON_SPACE[buf], offsets)
    return np.bincount(np.searchsorted(offsets, starts, side="right") - 1, minlength=len(offsets) - 1)


def sized(docs: DataFrame, text: str, doc_id: str, source: str) -> DataFrame:
    """doc_id, source, size and hash of the text of each row."""
    kinds = [docs.schema[c].dataType.simpleString() for c in (doc_id, source)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bv.column_bytes(batch.column(3))
            n = np.zeros(batch.num_rows, np.int64)
            for i, j in bv.slices(offsets):
                n[i:j] = word_counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n)], names=["doc_id", "source", "hash", "size"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(F.col(text).cast("string")).alias("hash"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(bv.lean(run), f"doc_id {kinds[0]}, source {kinds[1]}, hash long, size long")


def targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, rank, source_size, target: one row for each source, the only rows that are ordered as a whole."""
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = t.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    t = t.withColumn("w", (F.col("rank") % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * float(max_repeats))
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    # the share of a unit of weight if exactly the sources before this one were capped
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(below), F.lit(0.0))
    t = t.withColumn("unit", left / weight).withColumn("over", F.col("cap") < F.col("unit") * F.col("w"))
    level = F.min(F.when(~F.col("over"), F.struct(F.col("cap") / F.col("w"), "rank", "unit"))).over(everything)["unit"]
    return t.select("source", F.col("rank").cast("long").alias("rank"), "source_size", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def positions(sizes: DataFrame) -> DataFrame:
    """``sizes`` with each document's first word's number within its source."""
    # salted: buckets by hash, about 20,000 documents each over all sources
    rows = sizes.count()
    buckets = max(1, rows // 20_000)
    if buckets > 1:
        bucket = F.pmod(F.xxhash64("doc_id", "hash"), F.lit(buckets))
    else:
        bucket = F.lit(0).cast("long")
    s = sizes.withColumn("bucket", bucket)
    by = s.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by = by.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "hash").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return s.join(by, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select("doc_id", "source", "size", "hash", (F.col("base") + F.col("inner")).alias("start"))


def permute(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: balanced Feistel rounds, walked until inside."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([key & 0xFFFFFFFF, key >> 32 & 0xFFFFFFFF, n]).integers(0, 2**64, ROUNDS, dtype=np.uint64)
    x = np.asarray(i, np.uint64).copy()
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for k in keys:
            left, right = right, left ^ (bv.mix(right ^ k) & mask)
        x[todo] = left << np.uint64(half) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def deal(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each kind ``n`` draws without return take."""
    total = int(counts.sum())
    if total < 10**9:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    # beyond the generator's range chance moves a share by less than 0.0001: whole shares, and the rest by their fractions
    share = counts * (n / total)
    out = np.minimum(np.floor(share).astype(np.int64), counts)
    for k in np.argsort(-(share - out), kind="stable"):
        more = min(int(n - out.sum()), int(counts[k] - out[k]), 1)
        out[k] += more
    return out


def halves(lo: int, hi: int, counts: np.ndarray, first: np.ndarray, size: int, seed: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """The two halves of a range of shards: bounds, counts by source, and each source's slots before."""
    mid = (lo + hi) // 2
    left = deal(counts, (mid - lo) * size, np.random.default_rng([seed, lo, hi]))
    return [(lo, mid, left, first), (mid, hi, counts - left, first + left)]


def slots(goals: DataFrame, seed: int, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, slot, rank, block: the block that each slot of a shard takes."""
    spark = goals.sparkSession
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    # slots of a source: its target over the mean words of its blocks, which the last one lowers
    wanted = F.least(F.greatest(F.round(F.col("target") * blocks / F.col("source_size")), F.lit(1.0)), blocks * MAX_REPEATS).cast("long")
    got = goals.where("source_size > 0 and target > 0").select("rank", blocks.alias("blocks"), wanted.alias("slots")).orderBy("rank").collect()
    rank, blocks, counts = (np.array([r[k] for r in got], np.int64) for k in range(3))
    shards = -(-int(counts.sum()) // shard_slots)
    ranges = [(0, shards, counts, np.zeros(len(counts), np.int64))] if shards else []
    # the driver splits until there are ranges enough for the tasks, each a vector of sources
    while ranges and len(ranges) < min(shards, 4096, max(1, (4 << 20) // len(rank))) and any(r[1] - r[0] > 1 for r in ranges):
        ranges = [x for r in ranges for x in (halves(*r, shard_slots, seed) if r[1] - r[0] > 1 else [r])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            todo = [(lo, hi, np.array(c), np.array(f)) for lo, hi, c, f in zip(*(x.to_pylist() for x in batch.columns))]
            while todo:
                lo, hi, counts, first = todo.pop()
                if hi - lo > 1:
                    todo += halves(lo, hi, counts, first, shard_slots, seed)
                    continue
                out = np.empty(counts.sum(), np.int64)
                at = np.cumsum(counts) - counts
                for k in np.flatnonzero(counts):
                    j = np.arange(first[k], first[k] + counts[k])
                    for epoch in np.unique(j // blocks[k]):
                        mine = j // blocks[k] == epoch
                        out[at[k] : at[k] + counts[k]][mine] = permute(j[mine] % blocks[k], int(blocks[k]), zlib.crc32(f"{seed} {rank[k]} {epoch}".encode()))
                place = permute(np.arange(len(out)), len(out), zlib.crc32(f"{seed} shard {lo}".encode()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), lo)), pa.array(place), pa.array(np.repeat(rank, counts)), pa.array(out)], names=["shard", "slot", "rank", "block"])

    kind = pa.list_(pa.int64())
    table = pa.table([pa.array([r[0] for r in ranges], pa.int64()), pa.array([r[1] for r in ranges], pa.int64()), pa.array([r[2].tolist() for r in ranges], kind), pa.array([r[3].tolist() for r in ranges], kind)], names=["lo", "hi", "counts", "first"])
    return spark.createDataFrame(table).repartition(max(1, len(ranges))).mapInArrow(bv.lean(run), "shard long, slot long, rank long, block long")


def overlaps(placed: DataFrame, goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each document row's part of each block: from and to are words of the document."""
    p = placed.where("size > 0").join(goals.select(F.col("source").alias("s"), "rank"), F.col("source").eqNullSafe(F.col("s")))
    p = p.select("doc_id", "size", "hash", "rank", "start", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    lo = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    hi = F.least((F.col("block") + 1) * block - F.col("start"), F.col("size"))
    return p.select("doc_id", "size", "hash", "rank", "start", "block", lo.alias("lo"), hi.alias("hi"))


def plan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 17, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed documents, sources with targets, slots) of the mix; all are small beside the texts."""
    sizes = materialize(sized(docs, text, doc_id, source), "sizes")
    goals = materialize(targets(sizes), "targets")
    placed = materialize(positions(sizes), "placed")
    return placed, goals, materialize(slots(goals, seed, block, shard_slots), "slots")


def pieces(placed: DataFrame, goals: DataFrame, chosen: DataFrame, block: int = BLOCK) -> DataFrame:
    """Parts of documents in taken blocks with the number of times each is taken."""
    times = chosen.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))
    return overlaps(placed, goals, block).join(times, ["rank", "block"])


def taken(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 17, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken."""
    placed, goals, chosen = plan(docs, text, doc_id, source, seed, block)
    got = pieces(placed, goals, chosen, block).groupBy("rank", "start", "size", "hash").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"))
    g = goals.select(F.col("source").alias("s"), "rank", "source_size", "target")
    rows = placed.join(g, F.col("source").eqNullSafe(F.col("s")))
    # a start names one row of a source, but for rows without words
    out = rows.join(got, ["rank", "start", "size", "hash"], "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def _numbered(rows: DataFrame, keys: list[str], order: list, number: str, repeats: bool) -> DataFrame:
    """``rows`` with their number among those of equal keys; without repeats there is nothing to number."""
    if not repeats:
        return rows.withColumn(number, F.lit(1))
    return rows.withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def _keyed(docs: DataFrame, text: str, doc_id: str, source: str, placed: DataFrame) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """``docs`` and the placed rows with names that fit one to one: id, hash and number among equal ones."""
    repeats = placed.groupBy("doc_id", "hash").count().where("count > 1").limit(1).count() > 0
    h, n = fresh(docs, "h", "n")
    left = _numbered(docs.withColumn(h, F.xxhash64(F.col(text).cast("string"))), [doc_id, h], [F.col(source).asc_nulls_last()], n, repeats)
    right = _numbered(placed, ["doc_id", "hash"], ["rank", "start"], "n", repeats)
    return left, right, [doc_id, h, n], ["doc_id", "hash", "n"]


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", n_chars: str | None = "n_chars", seed: int = 17, block: int = BLOCK) -> DataFrame:
    """``docs`` as the mix holds them: each text is its taken words, repeats in a row.

    A document of which each block is taken once keeps its text as it is; in others taken
    words are joined by blanks, one line for each repetition. Documents of which nothing is
    taken go. Repeated rows stay as many as the mix takes. ``n_chars`` is set anew where present.
    """
    placed, goals, chosen = plan(docs, text, doc_id, source, seed, block)
    placed = placed.join(goals.select(F.col("source").alias("s"), "rank"), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "hash", "rank", "start")
    left, right, mine, theirs = _keyed(docs, text, doc_id, source, placed)
    p, k, size, parts = fresh(docs, "p", "k", "size", "parts")
    part = pieces(placed.drop("rank"), goals, chosen, block).groupBy("rank", "start", "size", "hash").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", F.col("times").cast("int").alias("times")))).alias("parts"))
    part = right.select(*theirs, "rank", "start", "size").join(part, ["rank", "start", "size", "hash"]).select(F.col("doc_id").alias(p), F.col("hash").alias(k), F.col("n").alias(f"{k}n"), F.col("size").alias(size), F.col("parts").alias(parts))
    rows = left.join(part, F.col(mine[0]).eqNullSafe(F.col(p)) & (F.col(mine[1]) == F.col(k)) & (F.col(mine[2]) == F.col(f"{k}n")))
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # few texts at a time become Python strings
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            texts = []
            for t, size, parts in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                texts.append(_take(t, size, [(p["lo"], p["hi"], p["times"]) for p in parts]))
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if n_chars in names:
                k = names.index(n_chars)
                columns[k] = pa.array([len(t) for t in texts], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.select(*names, size, parts).mapInArrow(bv.lean(run), docs.schema)


def shards(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 17, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix: shard, slot, source, block, words (their number), docs (ids with first and end word) and text of each slot.

    A block's words are joined by blanks, the parts of its documents by line feeds.
    """
    placed, goals, chosen = plan(docs, text, doc_id, source, seed, block, shard_slots)
    placed = placed.join(goals.select(F.col("source").alias("s"), "rank"), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "hash", "rank", "start")
    left, right, mine, theirs = _keyed(docs, text, doc_id, source, placed)
    kind = docs.schema[doc_id].dataType.simpleString()
    left = left.select(F.col(mine[0]).alias("d"), F.col(mine[1]).alias("h"), F.col(mine[2]).alias("m"), F.col(text).cast("string").alias("text"))
    rows = right.where("size > 0").join(left, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")) & (F.col("n") == F.col("m"))).select("doc_id", "rank", "start", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            for d, rank, start, t in zip(*(c.to_pylist() for c in batch.columns)):
                words = [w for w in t.translate(_BLANKS).split(" ") if w]
                edges = [0, *range(block - start % block, len(words), block), len(words)]
                spans = list(zip(edges, edges[1:]))
                n = len(spans)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rank] * n, pa.int64()), pa.array([(start + a) // block for a, _ in spans], pa.int64()), pa.array([start + a for a, _ in spans], pa.int64()), pa.array([d] * n, batch.column(0).type), pa.array([a for a, _ in spans], pa.int64()), pa.array([b for _, b in spans], pa.int64()), pa.array([" ".join(words[a:b]) for a, b in spans])],
                    names=["rank", "block", "start", "doc_id", "lo", "hi", "text"],
                )

    parts = rows.mapInArrow(bv.lean(cut), f"rank long, block long, start long, doc_id {kind}, lo long, hi long, text string")
    blocks = parts.groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("start", "doc_id", "lo", "hi", "text"))).alias("x"))
    blocks = blocks.select("rank", "block", F.aggregate("x", F.lit(0).cast("long"), lambda n, p: n + p["hi"] - p["lo"]).alias("words"), F.transform("x", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["lo"].alias("lo"), p["hi"].alias("hi"))).alias("docs"), F.array_join(F.col("x")["text"], "\n").alias("text"))
    return chosen.join(blocks, ["rank", "block"]).join(goals.select("rank", "source"), "rank").select("shard", "slot", "source", "block", "words", "docs", "text")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """``shards`` as Parquet, each shard's slots together and in order."""
    shards(docs, **options).repartitionByRange("shard").sortWithinPartitions("shard", "slot").write.parquet(path)


_BLANKS = str.maketrans("\t\n\v\f\r", "     ")


def _take(text: str, size: int, parts: list[tuple[int, int, int]]) -> str:
    if sum(hi - lo for lo, hi, _ in parts) == size and all(n == 1 for *_, n in parts):
        return text
    words = [w for w in text.translate(_BLANKS).split(" ") if w]
    lines = []
    for repeat in range(max(n for *_, n in parts)):
        lines.append(" ".join(w for lo, hi, n in parts if n > repeat for w in words[lo:hi]))
    return "\n".join(lines)

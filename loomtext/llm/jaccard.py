"""Near-duplicate join on word n-gram sets by chosen paths.

A document's set holds the 64-bit hashes of its runs of ``N`` lower-case words (of all its
words, where it has fewer). Documents with equal sets are collapsed into one class first, so
groups of copies of any size cost one row. Each class gets ``COORDINATES`` minhash values: the
embedded set whose tokens are pairs (coordinate, value).

Independent runs follow chosen paths: a run's root picks ``CHOICES`` coordinates, and sets
move to the bucket of each picked token. Buckets of one set end; those with at most ``BUCKET``
sets are brute-forced; larger ones pick 2 / threshold different coordinates and split again.
A bucket of which one child keeps more than half holds mutually similar sets: it is brute-forced
itself, in pairs of blocks of ``BLOCK_SETS``, and so is what is left at ``DEPTH``.

Runs are repeated until the target recall. The first ones are as many as reach it without
splits at the threshold. Then recall is measured on probes: ``PROBES`` sampled classes, and as
many of those whose buckets were split, each with a partner that agrees with it in every
coordinate by chance ``threshold``. The probes walk the very buckets that the classes made;
while fewer than ``RECALL`` of either kind meet in a bucket, another run follows. Pairs more
similar than the threshold are lost far more rarely.

Pairs whose minhash agreement or sizes rule out the threshold are dropped where they are
formed (their loss counts in the measured recall). A bucket's other pairs leave it as one row
for each set with a bit for each partner, never as rows of pairs. The pairs are verified
exactly from the sets, in blocks: a class joins its smallest
partner's smallest partner's group, groups are cut
into blocks of at most about ``BLOCK_BYTES`` and ``BLOCK_SETS`` sets, and each pair of blocks
that holds a candidate is compared as a whole, tile by tile, by products of incidence
matrices. A set travels once to each such pair of blocks where it has a candidate, and what
comes out of one is its sets' numbers of links and a spanning star of each of its components,
not every link. Components are then closed by alternating large-star and small-star
contraction.

Defined results: rows that share an id are one document, with its smallest text; rows with a
null id take no part. A document without words (null, empty, only signs) is a class of its own
without links. Texts may be of any length that a row can have: they are worked through piece by
piece, but one text's set, 8 bytes a distinct n-gram, must fit a task's memory several times.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import bytesvec as bv, scratch
from .scratch import materialize

N, THRESHOLD, RECALL, PROBES = 3, 0.5, 0.99, 2000
COORDINATES, CHOICES, BUCKET, DEPTH = 64, 2, 256, 8
BLOCK_SETS, BLOCK_BYTES, MEMBERS, COLUMNS = 1024, 4 << 20, 128, 1 << 14
#: Agreeing coordinates below which a pair is dropped: 4 standard deviations under the threshold.
SLACK = 4.0
#: Ids, with their routes, that may be broadcast instead of shuffling texts: about 16 bytes each.
MAX_BROADCAST_IDS = 500_000

_rng = np.random.default_rng(77)
_XOR = _rng.integers(0, 2**64, COORDINATES, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_sets(buf: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and distinct n-gram hashes, sorted by both."""
    doc, h, _, _ = bv.word_hashes(buf, offsets)
    at, g = bv.gram_hashes(doc, h, n)
    d = doc[at]
    if n > 1:
        count = np.bincount(doc, minlength=len(offsets) - 1)
        first = np.cumsum(count) - count
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            extra = []
            for s in short:
                x = np.uint64(0)
                for v in h[first[s] : first[s] + count[s]]:
                    x = bv.mix(np.array([x ^ v]))[0]
                extra.append(x)
            d, g = np.concatenate([d, short]), np.concatenate([g, np.array(extra, np.uint64)])
    order = np.lexsort((g, d))
    d, g = d[order], g[order]
    if len(g):
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])))
        d, g = d[new], g[new]
    return d, g


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def signatures(docs: DataFrame, text: str, doc_id: str, n: int) -> DataFrame:
    """doc_id, set size, class key (null without words) and minhash values of each row."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bv.column_bytes(batch.column(1))
            rows = batch.num_rows
            size, key, sig = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros((rows, COORDINATES), np.int16)
            for i, j in bv.slices(offsets):
                d, g = gram_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                if not len(g):
                    continue
                first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
                at = i + d[first]
                size[at] = np.diff(np.append(first, len(d)))
                # two sums of independently scrambled members name the set
                a, b = np.add.reduceat(bv.mix(g ^ np.uint64(0xA5A5)), first), np.bitwise_xor.reduceat(bv.mix(g ^ np.uint64(0x5A5A)), first)
                key[at] = bv.mix(a ^ bv.mix(b + size[at].astype(np.uint64)))
                for c in range(COORDINATES):
                    low = np.minimum.reduceat((g ^ _XOR[c]) * _MUL[c], first)
                    sig[at, c] = (bv.mix(low) >> np.uint64(48)).astype(np.uint16).view(np.int16)
            offs = pa.array(np.arange(rows + 1, dtype=np.int32) * COORDINATES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(key.view(np.int64), mask=size == 0), pa.ListArray.from_arrays(offs, pa.array(sig.ravel())), _fixed(sig.astype(np.uint8))], names=["doc_id", "size", "key", "sig", "low"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(bv.lean(run), f"doc_id {kind}, size long, key long, sig array<smallint>, low binary")


def one_per_id(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``docs`` without null ids; only where ids repeat is a shuffle paid to keep one row each."""
    docs = docs.where(F.col(doc_id).isNotNull())
    if docs.groupBy(doc_id).count().where("count > 1").limit(1).count() == 0:
        return docs
    order = Window.partitionBy(doc_id).orderBy(F.col(text).asc_nulls_last())
    (r,) = scratch.fresh(docs, "r")
    return docs.withColumn(r, F.row_number().over(order)).where(F.col(r) == 1).drop(r)


def _paths(classes: DataFrame, first: int, last: int) -> DataFrame:
    """``classes`` in the buckets (node) that the picks from ``first`` to ``last`` choose: coordinates are independent, so picks are a range of them."""
    rows = classes.withColumn("i", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return rows.withColumn("node", F.xxhash64("i", F.element_at("sig", F.col("i") + 1)))


def _split(rows: DataFrame, threshold: float) -> DataFrame:
    """``rows`` (node, sig and others) in the children of their buckets: node becomes parent.

    With two agreeing picks to be expected at the threshold, most pairs stay together however deep.
    """
    # a bucket's picks differ: the step is odd and COORDINATES a power of 2
    rows = rows.drop("i").withColumnRenamed("node", "parent").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(int(np.ceil(2 / threshold)) - 1))))
    rows = rows.withColumn("i", F.pmod(F.pmod(F.xxhash64("parent"), F.lit(COORDINATES)) + 21 * F.col("j"), F.lit(COORDINATES)).cast("int"))
    return rows.withColumn("node", F.xxhash64("parent", "i", F.element_at("sig", F.col("i") + 1))).drop("j")


def _need(threshold: float) -> int:
    """Coordinates that must agree for a pair to be promising."""
    return max(1, int(np.ceil(COORDINATES * threshold - SLACK * np.sqrt(COORDINATES * threshold * (1 - threshold)))))


#: Buckets of at most so many sets are compared side by side, larger ones each by itself.
_SMALL = 32


def bucket_pairs(sizes: np.ndarray, low: np.ndarray, node: np.ndarray, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of promising pairs within the runs of equal ``node``, compared at growing distance."""
    left, right = [], []
    live, step = np.arange(len(node)), 1
    while len(live):
        live = live[live + step < len(node)]
        live = live[node[live] == node[live + step]]
        for k in range(0, len(live), 1 << 15):
            a = live[k : k + (1 << 15)]
            b = a + step
            ok = (np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b])) & ((side[a] == 2) | (side[a] != side[b]))
            a, b = a[ok], b[ok]
            ok = (low[a] == low[b]).sum(1) >= _need(threshold)
            left.append(a[ok])
            right.append(b[ok])
        step += 1
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))


def bucket_matrix(sizes: np.ndarray, low: np.ndarray, side: np.ndarray, threshold: float) -> np.ndarray:
    """Which sets of one bucket are promising partners."""
    n, need = len(sizes), _need(threshold)
    out, columns = np.zeros((n, n), bool), np.ascontiguousarray(low.T)
    for a in range(0, n, 128):
        b = min(n, a + 128)
        agree = np.zeros((b - a, n), np.uint8)
        for c in columns:
            agree += c[a:b, None] == c[None, :]
        out[a:b] = agree >= need
        out[a:b] &= np.minimum(sizes[a:b, None], sizes[None, :]) >= threshold * np.maximum(sizes[a:b, None], sizes[None, :])
    np.fill_diagonal(out, False)
    return out & (side[:, None] != side[None, :]) if n and side[0] != 2 else out


_MET = "node long, pos int, key long, least long, bits binary"
_NONE = np.iinfo(np.int64).max


def _partners(node: np.ndarray, key: np.ndarray, sizes: np.ndarray, side: np.ndarray, low: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows ``_MET`` of whole buckets, the rows of each in a run."""
    first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    count = np.diff(np.append(first, len(node)))
    pos = np.arange(len(node)) - np.repeat(first, count)
    few = np.flatnonzero(np.repeat(count <= _SMALL, count))
    if len(few):
        a, b = (few[x] for x in bucket_pairs(sizes[few], low[few], node[few], side[few], threshold))
        # the partners' bits are different powers of 2, so that they add up
        bits = np.bincount(a, 2.0 ** pos[b], len(node)) + np.bincount(b, 2.0 ** pos[a], len(node))
        least = np.full(len(node), _NONE)
        np.minimum.at(least, a, key[b])
        np.minimum.at(least, b, key[a])
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(pos[at].astype(np.int32)), pa.array(key[at]), pa.array(least[at]), _fixed(bits[at].astype("<u4").view(np.uint8).reshape(-1, 4))], names=["node", "pos", "key", "least", "bits"])
    for f, n in zip(first[count > _SMALL], count[count > _SMALL]):
        x = slice(f, f + n)
        met = bucket_matrix(sizes[x], low[x], side[x], threshold)
        at = np.flatnonzero(met.any(1))
        least = np.concatenate([np.where(met[k : k + 256], key[None, x], _NONE).min(1) for k in range(0, n, 256)])
        yield pa.RecordBatch.from_arrays([pa.array(node[x][at]), pa.array(at.astype(np.int32)), pa.array(key[x][at]), pa.array(least[at]), _fixed(np.packbits(met[at], axis=1, bitorder="little"))], names=["node", "pos", "key", "least", "bits"])


def _by(rows: DataFrame, key: str) -> DataFrame:
    """Rows by key in a fixed number of partitions: merged by bytes, those with most comparisons would share a task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """The columns of the batches, cut so that no run of equal first values is parted."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        first = batch.column(0).to_numpy()
        cut = int(np.searchsorted(first, first[-1]))
        if cut or (rest and rest[-1].column(0)[-1].as_py() != first[0]):
            rest.append(batch.slice(0, cut))
            yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0].columns
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0].columns


def _bytes_of(column: pa.Array, width: int) -> np.ndarray:
    """A binary column whose values all have ``width`` bytes, as rows."""
    start = np.frombuffer(column.buffers()[1], np.int32, 1, column.offset * 4)[0]
    return np.frombuffer(column.buffers()[2], np.uint8, len(column) * width, start).reshape(-1, width)


def _brute(rows: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Promising partners within the buckets of ``rows`` (node, key, side), each bucket of bounded size.

    For comparing, a byte of each minhash value will do: one coordinate in 256 agrees by chance.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _runs_of(batches):
            node, key, size, side = (x.to_numpy() for x in columns[:4])
            yield from _partners(node, key, size, side, _bytes_of(columns[4], COORDINATES), threshold)

    rows = rows.join(classes.select("key", "size", "low"), "key").select("node", "key", "size", "side", "low")
    return _by(rows, "node").sortWithinPartitions("node").mapInArrow(bv.lean(run), _MET)


def _blocks(rows: DataFrame) -> DataFrame:
    """Buckets cut into blocks, and every pair of blocks as a bucket of its own."""
    blocks = F.ceil(F.col("many") / BLOCK_SETS).cast("int")
    mine = F.pmod(F.xxhash64("key"), blocks.cast("long")).cast("int")
    rows = rows.select("node", "key", mine.alias("x"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("y"))
    side = F.when(F.col("x") == F.col("y"), 2).otherwise((F.col("x") > F.col("y")).cast("int"))
    return rows.select(F.xxhash64("node", F.least("x", "y"), F.greatest("x", "y")).alias("node"), "key", side.alias("side"))


def _run(classes: DataFrame, first: int, last: int, threshold: float) -> tuple[list[DataFrame], list[DataFrame]]:
    """The partners (``_MET``) that picks ``first`` to ``last`` find, and the large buckets (node, ends) of each depth."""
    rows, found, large, paths = _paths(classes.select("key", "sig"), first, last).select("key", "node"), [], [], []
    for depth in range(DEPTH):
        counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
        # only ids and counts are shuffled until sets that stand alone in a bucket are gone
        met = materialize(rows.select("key", "node").join(counts, "node"), "buckets")
        big = met.where(F.col("many") > BUCKET)
        found.append(materialize(_brute(met.where(F.col("many") <= BUCKET).select("node", "key", F.lit(2).alias("side")), classes, threshold), "met"))
        if not big.limit(1).count():
            scratch.drop_tables(met)
            break
        if depth == DEPTH - 1:
            fates = materialize(big.groupBy("node").agg(F.lit(True).alias("ends")), "fates")
        else:
            kids = materialize(_split(big.join(classes.select("key", "sig"), "key"), threshold).select("key", "parent", "node", "many"), "buckets")
            largest = kids.groupBy("parent", "node").agg(F.count(F.lit(1)).alias("n"), F.max("many").alias("many")).groupBy("parent").agg((F.max("n") > 0.5 * F.max("many")).alias("ends"))
            fates = materialize(largest.withColumnRenamed("parent", "node"), "fates")
        large.append(fates)
        dense = big.join(fates.where("ends"), "node").select("node", "key", "many")
        found.append(materialize(_brute(_blocks(dense), classes, threshold), "met"))
        scratch.drop_tables(met)
        if depth == DEPTH - 1:
            break
        rows = kids.join(fates.where("not ends").select(F.col("node").alias("parent")), "parent", "left_semi").select("key", "node")
        paths.append(kids)
    scratch.drop_tables(*paths)
    return found, large


def first_runs(threshold: float) -> int:
    """Runs that reach ``RECALL`` at the threshold where no bucket is split."""
    if threshold >= 1:
        return 1
    return max(1, int(np.ceil(np.log(1 - RECALL) / (CHOICES * np.log(1 - threshold)))))


def _probes(classes: DataFrame, threshold: float, seed: int = 5) -> tuple[DataFrame, int] | None:
    """(pid, sig, and the coordinates (same) in which an invented partner agrees; without those that fail the first sight), and the number of all."""
    got = classes.select("key", "sig").orderBy(F.xxhash64("key")).limit(PROBES).toArrow()
    if not got.num_rows:
        return None
    n = got.num_rows
    same = np.random.default_rng([seed, n]).random((n, COORDINATES)) < threshold
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * COORDINATES)
    table = pa.table({"pid": np.arange(n), "sig": got["sig"].combine_chunks(), "same": pa.ListArray.from_arrays(offsets, pa.array(same.ravel()))})
    seen = classes.sparkSession.createDataFrame(table.filter(pa.array(same.sum(1) >= _need(threshold))))
    return seen, n


def _meet(probes: DataFrame, first: int, last: int, large: list[DataFrame], threshold: float) -> set[int]:
    """Numbers of the probes that share with their partners a bucket that is brute-forced."""
    agree = F.element_at("same", F.col("i") + 1)
    rows, found = _paths(probes, first, last).where(agree), set()
    for fates in [*large, None]:
        if fates is None:
            ended, rows = rows, None
        else:
            rows = rows.join(fates, "node", "left")
            ended = rows.where("ends is null or ends")
            rows = _split(rows.where("not ends").drop("ends"), threshold).where(agree).drop("parent")
        found |= {r[0] for r in ended.select("pid").distinct().collect()}
    return found


def candidates(classes: DataFrame, threshold: float) -> list[DataFrame]:
    """Promising partners (``_MET``) of all runs, repeated until the measured recall is ``RECALL``."""
    found, done, runs, kinds = [], 0, first_runs(threshold), None
    while True:
        new, large = _run(classes, done * CHOICES, runs * CHOICES - 1, threshold)
        found += new
        if kinds is None:
            kinds = [[_probes(classes, threshold), set()]]
            if large:
                # classes of split buckets are rare, but theirs are the longest paths
                split = _paths(classes.select("key", "sig"), done * CHOICES, runs * CHOICES - 1).join(large[0].where("not ends"), "node", "left_semi")
                kinds.append([_probes(split.dropDuplicates(["key"]), threshold, 6), set()])
            kinds = [k for k in kinds if k[0] is not None]
        enough = True
        for (probes, n), met in kinds:
            met |= _meet(probes, done * CHOICES, runs * CHOICES - 1, large, threshold)
            enough &= len(met) >= RECALL * n
        scratch.drop_tables(*large)
        done = runs
        if enough:
            break
        if (runs + 1) * CHOICES > COORDINATES:
            warnings.warn(f"near duplicates: the measured recall at the threshold {threshold} stays below {RECALL}", stacklevel=2)
            break
        runs += 1
    return found


def _routes(met: DataFrame, classes: DataFrame) -> DataFrame:
    """key, doc_id, routes: the pairs of blocks that a class's set must travel to, and its side there."""
    lead = met.groupBy("key").agg(F.min("least").alias("m")).select("key", F.least("key", "m").alias("lead")).join(classes.select("key", "size"), "key")
    lead = materialize(lead, "leads")
    # the lead's own lead: a few sets that miss the smallest of a group by chance would else be a group of their own
    lead = lead.join(lead.select(F.col("key").alias("lead"), F.col("lead").alias("first")), "lead").select("key", "size", F.col("first").alias("lead"))
    many = lead.groupBy("lead").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("size") * 8 / BLOCK_BYTES)).alias("n"))
    block = F.xxhash64("lead", F.pmod(F.xxhash64("key"), F.col("n")))
    members = materialize(lead.join(many, "lead").select("key", block.alias("block")), "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _runs_of(batches):
            node, pos, key, block = (x.to_numpy() for x in columns[:4])
            first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            alone = np.minimum.reduceat(block, first) == np.maximum.reduceat(block, first)
            at = np.flatnonzero(np.repeat(alone, np.diff(np.append(first, len(node)))))
            out = [np.stack([key[at], block[at], block[at]])]
            for f, e in zip(first[~alone], np.append(first[1:], len(node))[~alone]):
                names, code = np.unique(block[f:e], return_inverse=True)
                bits = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in columns[4].slice(f, e - f).to_pylist()]), axis=1, bitorder="little")[:, pos[f:e]]
                mine = (np.arange(len(names))[:, None] == code).astype(np.float32)
                x, y = np.nonzero(bits.astype(np.float32) @ mine.T > 0)
                out.append(np.stack([key[f:e][x], block[f:e][x], names[y]]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, 1)], names=["key", "x", "y"])

    # a set travels to a pair of blocks only if it has a promising partner there
    met = _by(met.join(members, "key").select("node", "pos", "key", "block", "bits"), "node").sortWithinPartitions("node", "pos")
    ways = met.mapInArrow(bv.lean(run), "key long, x long, y long").distinct()
    # side 0 and 1 are the two blocks; a block with itself is side 2
    side = F.when(F.col("x") == F.col("y"), 2).otherwise((F.col("x") > F.col("y")).cast("int"))
    ways = ways.groupBy("key").agg(F.collect_list(F.struct(F.xxhash64(F.least("x", "y"), F.greatest("x", "y")).alias("p"), side.alias("side"))).alias("routes"))
    out = materialize(ways.join(classes.select("key", F.col("rep").alias("doc_id")), "key").select("key", "doc_id", "routes"), "routes")
    scratch.drop_tables(members)
    return out


def linked_tiles(sets: list[np.ndarray], side: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """Coefficients of the sets of side 0 with those of side 1, or of all with all: first and last row and column of each tile, and its values.

    Tiles hold at most ``MEMBERS`` sets a side, fewer where they are large.
    """
    bytes_, cuts = np.array([x.nbytes for x in sets]), [0]
    for i in range(len(sets)):
        if i - cuts[-1] >= MEMBERS or bytes_[cuts[-1] : i + 1].sum() > BLOCK_BYTES and i > cuts[-1] or i and side[i] != side[i - 1]:
            cuts.append(i)
    tiles = list(zip(cuts, [*cuts[1:], len(sets)]))
    for k, (a, b) in enumerate(tiles):
        for c, d in tiles[k:]:
            if side[a] == 2 or side[a] != side[c]:
                both = sets[a:b] + (sets[c:d] if c > a else [])
                j = jaccards(both)
                yield a, b, c, d, j[: b - a, b - a :] if c > a else j


def jaccards(sets: list[np.ndarray]) -> np.ndarray:
    """Coefficients of all with all; 0 of each with itself."""
    n = np.array([len(s) for s in sets])
    owner, flat = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owner, flat = owner[order], flat[order]
    start = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    count = np.diff(np.append(start, len(flat)))
    # members of one set only meet nothing
    keep = np.repeat(count > 1, count)
    owner, column = owner[keep], np.repeat(np.cumsum(count > 1) - 1, count)[keep]
    common = np.zeros((len(sets), len(sets)))
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + COLUMNS, COLUMNS))
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            m = np.zeros((len(sets), COLUMNS), np.float32)
            m[owner[a:b], column[a:b] % COLUMNS] = 1
            common += m @ m.T
    j = common / np.maximum(n[:, None] + n[None, :] - common, 1)
    np.fill_diagonal(j, 0)
    return j


def _stars(linked: np.ndarray) -> np.ndarray:
    """Number of the first member of each one's component."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1, initial=len(label)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def verify(ids: DataFrame, docs: DataFrame, text: str, doc_id: str, n: int, threshold: float, links: bool = False) -> DataFrame:
    """What the exact coefficients of the blocks' pairs give; ``ids`` are key, doc_id and routes.

    key, root, many: for each linked class of a pair of blocks, a class of its component there
    and its number of links there. With ``links``, each link: a, b, jaccard.
    """
    if (ids.agg(F.sum(1 + F.size("routes"))).collect()[0][0] or 0) <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bv.column_bytes(batch.column(2))
            routes = batch.column(1)
            for i, j in bv.slices(offsets):
                d, g = gram_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                ends = np.searchsorted(d, np.arange(j - i + 1))
                rows = [(r["p"], r["side"], k) for k in range(j - i) for r in routes[i + k].as_py()]
                raw = [g[ends[k] : ends[k + 1]].tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, *_ in rows], pa.int64()), pa.array([s for _, s, _ in rows], pa.int32()), batch.column(0).take(pa.array([i + k for *_, k in rows], pa.int64())), pa.array([raw[k] for *_, k in rows], pa.binary())], names=["p", "side", "key", "set"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes]] = []
        now: int | None = None

        def out() -> pa.RecordBatch:
            rows.sort(key=lambda r: (r[1], r[0]))
            key, side = np.array([k for k, *_ in rows], np.int64), np.array([s for _, s, _ in rows])
            linked, found = np.zeros((len(rows), len(rows)), bool), []
            for a, b, c, d, j in linked_tiles([np.frombuffer(x, np.uint64) for *_, x in rows], side):
                ok = j >= threshold
                linked[a:b, c:d] |= ok
                linked[c:d, a:b] |= ok.T
                if links:
                    x, y = np.nonzero(np.triu(ok) if a == c else ok)
                    found.append((a + x, c + y, j[x, y]))
            if links:
                a, b, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
                return pa.RecordBatch.from_arrays([pa.array(key[a]), pa.array(key[b]), pa.array(j)], names=["a", "b", "jaccard"])
            many = linked.sum(1)
            at = np.flatnonzero(many)
            return pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(key[_stars(linked)][at]), pa.array(many[at].astype(np.int64))], names=["key", "root", "many"])

        for batch in batches:
            for p, side, key, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if p != now:
                    if len(rows) > 1:
                        yield out()
                    rows.clear()
                    now = p
                rows.append((key, side, raw))
        if len(rows) > 1:
            yield out()

    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(ids, "doc_id").select("key", "routes", "text")
    sent = _by(texts.mapInArrow(bv.lean(send), "p long, side int, key long, set binary"), "p").sortWithinPartitions("p")
    return sent.mapInArrow(bv.lean(compare), "a long, b long, jaccard double" if links else "key long, root long, many long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each linked node's component."""
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    before = None
    while True:
        sides = e.union(e.select("v", "u"))
        low = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, e = e, materialize(small, "stars")
        scratch.drop_tables(last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if now == before:
            out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out.scratch_path = e.scratch_path
            return out
        before = now


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Documents with their classes, and the links between different sets.

    Documents: doc_id, class_id (smallest id among all linked documents), copy_id (smallest id
    among documents with the same set), n_copies (documents with that set), n_links (linked
    other sets). Links, computed only if used: id_a, id_b (smallest ids of two sets), jaccard.
    """
    if not 0.1 <= threshold <= 1:
        raise ValueError("the threshold must be from 0.1 to 1")
    spark = docs.sparkSession
    docs = one_per_id(docs, text, doc_id)
    sigs = materialize(signatures(docs, text, doc_id, n), "signatures")
    classes = sigs.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("low").alias("low"))
    classes = materialize(classes, "classes")
    # from here on, the ids and the classes' names are enough
    ids, names = materialize(sigs.select("doc_id", "key"), "ids"), materialize(classes.select("key", "rep", "n_copies"), "names")
    scratch.drop_tables(sigs)
    met = candidates(classes, threshold)
    routes = _routes(functools.reduce(DataFrame.union, met), classes)
    scratch.drop_tables(classes, *met)
    scratch.release(spark)
    found = materialize(verify(routes, docs, text, doc_id, n, threshold), "found")
    roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy("key").agg(F.sum("many").alias("n_links"))
    table = names.join(degree, "key", "left").join(roots.toDF("key", "root"), "key", "left")
    table = table.withColumn("root", F.coalesce("root", "key"))
    first = table.groupBy("root").agg(F.min("rep").alias("class_id"))
    table = table.join(first, "root")
    out = ids.join(table, "key", "left")
    out = materialize(out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("rep", "doc_id").alias("copy_id"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "near")
    scratch.drop_tables(ids, found, roots)
    scratch.release(spark)
    reps = names.select("key", "rep")
    links = verify(routes, docs, text, doc_id, n, threshold, links=True).join(reps.toDF("a", "ra"), "a").join(reps.toDF("b", "rb"), "b")
    return out, links.select(F.least("ra", "rb").alias("id_a"), F.greatest("ra", "rb").alias("id_b"), "jaccard")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, with the smallest id of each class; rows with a null id stay."""
    found, _ = near_duplicates(docs, text, doc_id, n, threshold)
    (name,) = scratch.fresh(docs, "drop")
    drop = materialize(found.where("doc_id <> class_id").select(F.col("doc_id").alias(name)), "drop")
    many = drop.count()
    left = one_per_id(docs, text, doc_id).join(F.broadcast(drop) if many <= MAX_BROADCAST_IDS else drop, F.col(doc_id) == F.col(name), "left_anti")
    nulls = docs.where(F.col(doc_id).isNull())
    return left.union(nulls) if nulls.limit(1).count() else left

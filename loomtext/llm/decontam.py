"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching.

Texts and test items are compared as lower-case word sequences. Hashes of all runs of
``MIN_TILE`` words of the items are the seeds. A document that shares seeds with an item, and
whose seeds could cover ``threshold`` of the item's words, is tiled: the longest common run
that overlaps no earlier tile, in either text, is marked, again and again, until none has
``MIN_TILE`` words. Tiles may come in any order, so reordered passages are caught. The pair is
contaminated when the tiles cover at least ``threshold`` of the item's words.

Items whose bytes stay under ``max_broadcast_bytes`` are sent to all tasks and the documents
are scanned in place, without a shuffle. Beyond it the seeds are joined by a shuffle: an item's
most frequent seeds are left out as far as the others must hold a match anyway, seeds of more
than ``HOT`` documents are salted, and a document's text travels once, to the items whose
threshold its seeds can reach.

Defined results: texts may be of any length, with 50 bytes of memory a word. Null or
empty texts match nothing. Items with fewer than ``MIN_TILE`` words
are too short to be evidence and match nothing. Equal items match each under its own id, with
null item ids allowed. Repeated documents give repeated rows. Documents with a null id are
scanned, and filtered, like others. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import bytesvec as bv
from .scratch import fresh, materialize

MIN_TILE, THRESHOLD, MAX_BROADCAST, HOT = 4, 0.6, 16 << 20, 10_000


def tile(doc: np.ndarray, item: np.ndarray, pairs: np.ndarray, s: int) -> list[tuple[int, int, int]]:
    """Greedy tiling (document place, item place, length) from the seeds ``pairs``, rows (i, j) where s words agree."""
    order = np.lexsort((pairs[:, 0], pairs[:, 0] - pairs[:, 1]))
    i, j = pairs[order, 0], pairs[order, 1]
    diagonal = i - j
    first = np.flatnonzero(np.concatenate(([True], (diagonal[1:] != diagonal[:-1]) | (i[1:] != i[:-1] + 1))))
    size = np.diff(np.append(first, len(i))) + s - 1
    heap = [(-int(n), int(a), int(b)) for n, a, b in zip(size, i[first], j[first])]
    heapq.heapify(heap)
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    tiles = []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = ~(in_doc[a : a + n] | in_item[b : b + n])
        if free.all():
            in_doc[a : a + n] = in_item[b : b + n] = True
            tiles.append((a, b, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([False], free, [False])).astype(np.int8)))
        for x, y in zip(edge[::2], edge[1::2]):
            if y - x >= s:
                heapq.heappush(heap, (-int(y - x), a + int(x), b + int(x)))
    return tiles


class Items:
    """The test items' words and seeds."""

    def __init__(self, ids: list, texts: list[str | None], s: int, threshold: float):
        self.ids, self.s, self.threshold = ids, s, threshold
        data, offsets = bv.column_bytes(pa.array([t or "" for t in texts], pa.large_string()))
        doc, h, _, _ = bv.word_hashes(data, offsets)
        self.words = [h[a:b] for a, b in zip(*(lambda c: (c[:-1], c[1:]))(np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(ids)))))))] if len(ids) else []
        at, g = bv.gram_hashes(doc, h, s)
        self.longest = max((len(w) for w in self.words), default=0)
        start = np.concatenate(([0], np.cumsum([len(w) for w in self.words]))).astype(np.int64)
        order = np.argsort(g, kind="stable")
        self.seeds = bv.HashSet(g)
        self.bounds = np.concatenate((np.searchsorted(g[order], self.seeds.values), [len(g)]))
        self.item, self.place = doc[at][order], (at - start[doc[at]])[order]

    def matches(self, doc: np.ndarray, h: np.ndarray, rows: int) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(row, item number, tiles) of contaminated pairs among these rows' words."""
        at, g = bv.gram_hashes(doc, h, self.s)
        hit, seed = self.seeds.find(g)
        if not len(hit):
            return
        where = at[hit]
        # of one word repeated on and on, twice the longest item holds every tile
        run = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1] + 1) | (seed[1:] != seed[:-1]))))
        near = np.arange(len(where)) - np.repeat(run, np.diff(np.append(run, len(where)))) < 2 * self.longest
        where, seed = where[near], seed[near]
        order = np.lexsort((where, seed, doc[where]))
        where, seed = where[order], seed[order]
        row = doc[where]
        # distinct (row, seed), and the places of each in the items
        first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (seed[1:] != seed[:-1]))))
        last = np.append(first[1:], len(where))
        times = self.bounds[seed[first] + 1] - self.bounds[seed[first]]
        pick = np.repeat(self.bounds[seed[first]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        group, item, spot = np.repeat(np.arange(len(first)), times), self.item[pick], self.place[pick]
        start = np.searchsorted(doc, np.arange(rows + 1))
        key = row[first][group] * len(self.ids) + item
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
        for a, b in zip(cuts, np.append(cuts[1:], len(order))):
            mine = order[a:b]
            r, k = int(row[first[group[mine[0]]]]), int(item[mine[0]])
            m = len(self.words[k])
            need = self.threshold * m
            spots = np.unique(spot[mine])
            if len(spots) * self.s < need:
                continue
            covered = np.zeros(m, bool)
            for o in range(self.s):
                covered[spots + o] = True
            if covered.sum() < need:
                continue
            # only now every place of a seed in the text meets every place in the item
            many = (last - first)[group[mine]]
            places = where[np.repeat(first[group[mine]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            tiles = tile(h[start[r] : start[r + 1]], self.words[k], np.stack([places - start[r], np.repeat(spot[mine], many)], 1), self.s)
            if sum(n for _, _, n in tiles) >= need:
                yield r, k, tiles

    def scan(self, column: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        data, offsets = bv.column_bytes(column)
        for i, j in bv.slices(offsets):
            doc, h, _, _ = bv.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for r, k, tiles in self.matches(doc, h, j - i):
                yield i + r, k, tiles


def _small(benchmark: DataFrame, item_id: str, text: str, limit: int) -> tuple[list, list] | None:
    """Ids and texts of the items if their bytes are within the limit."""
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(text).cast("string").alias("t"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 16)).collect()[0][0] or 0
    if total > limit:
        return None
    got = rows.orderBy("i", "t").collect()
    return [r[0] for r in got], [r[1] for r in got]


_OUT = "item_words int, matched_words int, tiles int, coverage double, spans array<struct<doc_word:int,item_word:int,words:int>>"


def _record(found: list, words: list[int], s_ids: pa.Array, i_ids: pa.Array) -> pa.RecordBatch:
    matched = [sum(n for _, _, n in t) for *_, t in found]
    spans = [[{"doc_word": a, "item_word": b, "words": n} for a, b, n in sorted(t)] for *_, t in found]
    kind = pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [s_ids, i_ids, pa.array(words, pa.int32()), pa.array(matched, pa.int32()), pa.array([len(t) for *_, t in found], pa.int32()), pa.array([a / b for a, b in zip(matched, words)], pa.float64()), pa.array(spans, kind)],
        names=["doc_id", "item_id", "item_words", "matched_words", "tiles", "coverage", "spans"],
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", min_tile: int = MIN_TILE, threshold: float = THRESHOLD, max_broadcast_bytes: int = MAX_BROADCAST) -> DataFrame:
    """One row per contaminated (document row, item): counts, coverage and the tiles."""
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, {_OUT}"
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    small = _small(benchmark, item_id, item_text, max_broadcast_bytes)
    if small is None:
        return _joined(rows, benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("item")), schema, min_tile, threshold)
    ids, texts = small
    id_type = to_arrow_type(benchmark.schema[item_id].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(ids, texts, min_tile, threshold)
        for batch in batches:
            found = list(items.scan(batch.column(1)))
            if found:
                d = batch.column(0).take(pa.array([r for r, *_ in found]))
                yield _record(found, [len(items.words[k]) for _, k, _ in found], d, pa.array([ids[k] for _, k, _ in found], id_type))

    return rows.mapInArrow(bv.lean(run), schema)


def _joined(docs: DataFrame, items: DataFrame, schema: str, s: int, threshold: float) -> DataFrame:
    """The same pairs with seeds joined by a shuffle, for item sets of any size.

    Rows are keyed by their content, so equal rows are searched once. The join is on seeds that
    both sides have, one row for each text and distinct seed.
    """

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """key, seed, its places in the text, and the text's words."""
        for batch in batches:
            data, offsets = bv.column_bytes(batch.column(1))
            for i, j in bv.slices(offsets):
                doc, h, _, _ = bv.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at, g = bv.gram_hashes(doc, h, s)
                if len(at):
                    order = np.lexsort((g, doc[at]))
                    d, g = doc[at][order], g[order]
                    first = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (d[1:] != d[:-1]))))
                    d, places = d[first], np.diff(np.append(first, len(g)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d + i)), pa.array(g[first].view(np.int64)), pa.array(places), pa.array(np.bincount(doc, minlength=j - i)[d])], names=["key", "seed", "places", "words"])

    kind = "key long, seed long, places long, words long"
    d = docs.withColumn("k", F.xxhash64("doc_id", "text"))
    t = items.withColumn("q", F.xxhash64("item_id", "item")).dropDuplicates(["q"])
    right = materialize(t.select("q", "item").mapInArrow(bv.lean(seeds), kind), "item-seeds")
    left = d.select("k", "text").mapInArrow(bv.lean(seeds), kind).select("key", "seed").distinct()
    left = materialize(left.join(right.select("seed").distinct(), "seed", "left_semi"), "seeds")
    found = left.groupBy("seed").agg(F.count(F.lit(1)).alias("df"))
    # an item needs so many places in the text; its most frequent seeds are left out while fewer than that
    order = Window.partitionBy("q").orderBy(F.desc("df"), "seed").rowsBetween(Window.unboundedPreceding, 0)
    need = F.col("words") * threshold / s
    ranked = right.withColumnRenamed("key", "q").join(found, "seed").withColumn("before", F.sum("places").over(order))
    without = F.max(F.when(F.col("before") < need, F.col("before")).otherwise(0)).over(Window.partitionBy("q"))
    ranked = materialize(ranked.withColumn("without", without).where(F.col("before") >= need), "ranked")
    # a hot seed's rows are spread: salted on the documents' side, repeated on the items'
    salts = F.ceil(F.col("df") / HOT).cast("int")
    hot = ranked.where(F.col("df") > HOT).select("seed", salts.alias("salts")).distinct()
    few = hot.count() <= 100_000
    left = left.join(F.broadcast(hot) if few else hot, "seed", "left").withColumn("salt", F.pmod(F.xxhash64("key"), F.coalesce("salts", F.lit(1)).cast("long")).cast("int"))
    right = ranked.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    pairs = left.select("key", "seed", "salt").join(right.select("q", "seed", "salt", "places", "words", "without"), ["seed", "salt"])
    pairs = pairs.groupBy("key", "q").agg(F.sum("places").alias("n"), F.max("without").alias("without"), F.max("words").alias("words")).where((F.col("n") + F.col("without")) * s >= F.col("words") * threshold)
    asked = pairs.join(t, "q").groupBy("key").agg(F.collect_list(F.struct("item_id", "item")).alias("items"))
    both = d.join(asked, F.col("k") == F.col("key")).select("doc_id", "text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                asked = batch.column(2)[r].values
                one = Items(list(range(len(asked))), asked.field(1).to_pylist(), s, threshold)
                found = list(one.scan(batch.column(1).slice(r, 1)))
                if found:
                    yield _record(found, [len(one.words[k]) for _, k, _ in found], batch.column(0).take(pa.array([r] * len(found))), asked.field(0).take(pa.array([k for _, k, _ in found])))

    return both.mapInArrow(bv.lean(run), schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", min_tile: int = MIN_TILE, threshold: float = THRESHOLD, max_broadcast_bytes: int = MAX_BROADCAST) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that hold no test item."""
    small = _small(benchmark, item_id, item_text, max_broadcast_bytes)
    if small is None:
        key = F.xxhash64(F.lit(0), F.col(text))
        keyed = docs.select(key.alias("doc_id"), F.col(text).alias(text))
        (name,) = fresh(docs, "bad")
        bad = contaminated(keyed, benchmark, text, "doc_id", item_id, item_text, min_tile, threshold, max_broadcast_bytes).select(F.col("doc_id").alias(name)).distinct()
        return docs.join(bad, key == F.col(name), "left_anti")
    ids, texts = small
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(ids, texts, min_tile, threshold)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for r, *_ in items.scan(batch.column(at)):
                keep[r] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(bv.lean(run), docs.schema)

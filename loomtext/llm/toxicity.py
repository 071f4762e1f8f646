"""Toxicity from the nearest labelled examples by TF-IDF cosine over whole texts.

1. A bounded sample of labelled documents that aren't held out (at most ``positives`` and
   ``negatives``, smallest hash of the id first, and ``max_bytes`` of text) gives the examples,
   with all their words.
2. One pass over all whole texts counts in how many documents each of these words occurs; all
   other words share ``OTHERS`` counters by their hash, which serve the vectors' norms alone. A
   word's weight is (1 + ln tf) * idf * (``FLOOR`` + lift), lift being the log odds ratio of its
   document frequencies in the two classes less ``DEVIATIONS`` standard errors, or 0 if that is
   negative. Every word keeps a weight. Under plain TF-IDF (lift 0 for all words) the rare words
   of a text drown the few that are toxic: precision 0.67 and recall 0.72 on held-out rows of
   ``check_s``, against 0.99 and 1.00.
3. The examples form an inverted index in blocks of ``BLOCK`` alike examples; the most common
   terms' weights stand in full rows with each block's maximum, the others in posting lists. A
   document's ``neighbours`` nearest examples are found exactly: the postings' sums and the rows'
   maxima bound every cosine in a block, each document's best block is scored first, and of the
   others only those whose bound reaches the last neighbour's cosine. Documents go through the
   index ``TOGETHER`` at a time.
4. Similarity-weighted votes, shrunk to the base rate, are calibrated by isotonic regression
   on leave-one-out votes of the examples.

Defined results: texts without words (null, empty, only signs) get the examples' rate of toxic
labels and no evidence; without labels all scores are 0. Ids may repeat or be null (such rows
are scored; of rows that share an id the smallest text is the example, null ids are never one).
Conflicting labels of one id count as toxic. A document is never its own neighbour. Equal
cosines go to the smaller id. Texts of any length are worked through as wholes. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import bytesvec as bv, scratch
from .langid import fold_of, held_out
from .scratch import materialize

BLOCK, TOGETHER, ROWS = 128, 128, 384
PRIOR_WEIGHT, FLOOR, DEVIATIONS = 0.3, 0.02, 2.0
#: Shared document counters of words that no example has; counters a row when tasks add theirs up.
OTHERS, PART = 1 << 18, 1 << 10


def expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each ``first``, ``count`` of them, one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)


class BlockMaxIndex:
    """Exact top-k cosine over unit vectors, block by block under term-maximum bounds.

    ``owner``, ``term`` and ``weight`` are the vectors' entries; terms are numbers below ``terms``.
    """

    def __init__(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, ids: np.ndarray, labels: np.ndarray, terms: int):
        n, self.block = len(ids), BLOCK
        keep = weight > 0
        owner, term, weight = owner[keep].astype(np.int32), term[keep].astype(np.int32), weight[keep]
        # alike vectors share a block: by their most common term, which tells the language, then by their strongest one and their number of terms
        df, size = np.bincount(term, minlength=terms), np.bincount(owner, minlength=n)
        common, strong = np.full(n, -1), np.full(n, -1)
        for to, by in ((common, df[term]), (strong, weight)):
            o = np.lexsort((term, by, owner))
            last = np.flatnonzero(np.append(owner[o][1:] != owner[o][:-1], True)) if len(o) else o
            to[owner[o][last]] = term[o][last]
        top = np.zeros(n)
        np.maximum.at(top, owner, weight)
        order = np.lexsort((ids, size, np.where(top > 0.3, strong, -1), common))
        self.ids, self.labels, self.blocks = ids[order], labels[order].astype(float), -(-n // self.block)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        # full rows for the most common terms, in at least one of 32 examples
        full = np.argsort(-df, kind="stable")[:ROWS]
        full = full[df[full] * 32 >= n]
        self.row = np.full(terms, -1, np.int16)
        self.row[full] = np.arange(len(full))
        self.width = self.blocks * self.block
        self.rows = np.zeros((len(full), self.width))
        mine = self.row[term] >= 0
        self.rows[self.row[term[mine]], place[owner[mine]]] = weight[mine]
        self.maximum = self.rows.reshape(len(full), self.blocks, self.block).max(2) if self.blocks else np.zeros((len(full), 0))
        owner, term, weight = owner[~mine], term[~mine], weight[~mine]
        o = np.argsort(term, kind="stable")
        self.example, self.weight = place[owner[o]].astype(np.int32), weight[o]
        self.first = np.searchsorted(term[o], np.arange(terms + 1)).astype(np.int32)
        self.place = {int(d): k for k, d in enumerate(self.ids)}
        self.visits = 0

    def top(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int, k: int, not_ids: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """Cosines and example numbers of the k nearest with a common term of each of the unit vectors (doc, term, weight), sorted by doc."""
        out = []
        for a in range(0, rows, TOGETHER):
            b = min(rows, a + TOGETHER)
            x = slice(*np.searchsorted(doc, (a, b)))
            out += self._top(doc[x] - a, term[x], weight[x], b - a, k, not_ids[a:b])
        return out

    def _top(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, m: int, k: int, not_ids: list) -> list[tuple[np.ndarray, np.ndarray]]:
        row = self.row[term].astype(np.int64)
        common = np.zeros((m, len(self.rows)))
        at = row >= 0
        common[doc[at], row[at]] = weight[at]
        doc, term, weight = doc[~at], term[~at], weight[~at]
        count = self.first[term + 1] - self.first[term]
        p = expand(self.first[term], count)
        rare = np.bincount(np.repeat(doc * self.width, count) + self.example[p], np.repeat(weight, count) * self.weight[p], m * self.width).reshape(m, self.width)
        for i, d in enumerate(not_ids):
            if d in self.place:
                rare[i, self.place[d]] = -9.0
        bounds = rare.reshape(m, self.blocks, self.block).max(2) + common @ self.maximum
        least, best = np.zeros(m), np.zeros((m, k))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def visit(b: int, r: np.ndarray) -> None:
            self.visits += len(r)
            x = slice(b * self.block, (b + 1) * self.block)
            # scores are compared as rounded, for the order of summing differs
            score = np.round(rare[r, x] + common[r] @ self.rows[:, x], 12)
            i, j = np.nonzero((score >= least[r, None]) & (score > 0))
            found.append((r[i], b * self.block + j, score[i, j]))
            some = np.unique(i)
            best[r[some]] = np.partition(np.concatenate((best[r[some]], score[some]), 1), self.block, axis=1)[:, self.block:]
            least[r] = best[r].min(1)

        first = bounds.argmax(1)
        for b in np.unique(first):
            visit(b, np.flatnonzero((first == b) & (bounds[:, b] > 0)))
        bounds[np.arange(m), first] = -1.0
        for b in np.argsort(-bounds.max(0), kind="stable"):
            r = np.flatnonzero((bounds[:, b] > 0) & (bounds[:, b] >= least - 1e-11))
            if len(r):
                visit(b, r)
        r, near, score = (np.concatenate(x) for x in zip(*found))
        keep = score >= least[r]
        r, near, score = r[keep], near[keep], score[keep]
        o = np.lexsort((self.ids[near], -score, r))
        cut = np.searchsorted(r[o], np.arange(m + 1))
        return [(score[o[x : min(x + k, y)]], near[o[x : min(x + k, y)]]) for x, y in zip(cut, cut[1:])]


#: What this worker read last.
_loaded: dict[str, object] = {}


def save(thing: object, folder: str) -> str:
    """Write to the shared folder, from where each worker reads it once: a broadcast would lie on every disk twice. The name is the attempt's own."""
    fs, name = scratch.filesystem(folder)
    fs.create_dir(name, recursive=True)
    part = uuid.uuid4().hex
    with fs.open_output_stream(f"{name}/{part}") as f:
        pickle.dump(thing, f, protocol=5)
    return f"{folder}/{part}"


def load(path: str) -> object:
    if path not in _loaded:
        fs, name = scratch.filesystem(path)
        _loaded.clear()
        with fs.open_input_stream(name) as f:
            _loaded[path] = pickle.load(f)  # noqa: S301 (our own file)
    return _loaded[path]


class Model:
    """Word weights and the index."""

    def __init__(self, words: np.ndarray, weight: np.ndarray, other: np.ndarray, base: float, neighbours: int):
        self.words, self.weight, self.other, self.base, self.k = words, weight, other, base, neighbours
        self.index: BlockMaxIndex | None = None

    def vectors(self, known: bv.HashSet, doc: np.ndarray, h: np.ndarray, count: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, terms and weights of unit vectors, of distinct (text, word) pairs with counts."""
        at, term = known.find(h)
        w = (1 + np.log(count)) * FLOOR * self.other[h & np.uint64(OTHERS - 1)]
        w[at] = (1 + np.log(count[at])) * self.weight[term]
        norm = np.sqrt(np.bincount(doc, w * w, rows))
        return doc[at], term, w[at] / norm[doc[at]]

    def votes(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int, not_ids: list) -> list[tuple[float, np.ndarray]]:
        """The uncalibrated score of each vector, and its nearest examples."""
        near = self.index.top(doc, term, weight, rows, self.k, not_ids)
        return [(float((s @ self.index.labels[i] + PRIOR_WEIGHT * self.base) / (s.sum() + PRIOR_WEIGHT)), i) for s, i in near]


def distinct_words(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, word) pairs, sorted, with counts; words are named by 48 bits of their hashes, texts are fewer than 2**16."""
    key = doc.astype(np.uint64) << np.uint64(48) | h >> np.uint64(16)
    key.sort()
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    count, key = np.diff(np.append(first, len(key))), key[first]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), count


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the texts and their distinct words."""
    data, offsets = bv.column_bytes(column)
    for a, b in bv.slices(offsets):
        for i in range(a, b, 1 << 16):
            j = min(b, i + (1 << 16))
            doc, h, _, _ = bv.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield i, j, *distinct_words(doc, h)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step fit (pool adjacent violators), with one pseudo-row at each end."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, count, sum of x
    for i in order:
        pools.append([y[i], 1.0, x[i]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            a = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], a)]
    return np.array([0.0] + [p[2] / p[1] for p in pools] + [1.0]), np.array([0.0] + [p[0] / p[1] for p in pools] + [1.0])


def sample_labels(labels: DataFrame, doc_id: str, label: str, positives: int, negatives: int) -> DataFrame:
    """doc_id, label of at most so many examples of each class, smallest hash of the id first."""
    one = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold_of("doc_id") != 1))
    one = materialize(one.groupBy("doc_id").agg((F.max("label") == 1).cast("int").alias("label")).withColumn("h", F.xxhash64("doc_id")), "labels")
    sizes = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    cap = F.when(F.col("label") == 1, positives).otherwise(negatives)
    # hashes are uniform: a bound on them leaves little more than the cap to be ordered, by two tasks
    kept = F.lit(False)
    for kind, most in ((1, positives), (0, negatives)):
        share = min(1.0, (most + 8 * most**0.5 + 20) / max(1, sizes.get(kind, 0)))
        kept |= (F.col("label") == kind) & (F.col("h") <= min(2**63 - 1, int(share * 2**64) - 2**63))
    order = Window.partitionBy("label").orderBy("h", "doc_id")
    return one.where(kept).withColumn("r", F.row_number().over(order)).where(F.col("r") <= cap).select("doc_id", "label", "h")


_EXAMPLES = "doc_id long, label int, h binary, n binary"


def _examples(docs: DataFrame, sample: DataFrame, text: str, doc_id: str, max_bytes: int) -> DataFrame:
    """The examples (``_EXAMPLES``) with the hashes and counts of their distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, doc, h, count in _texts(batch.column(2)):
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *(pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()) for x in (h, count.astype(np.int32)))], names=["doc_id", "label", "h", "n"])

    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("h").alias("h"))
    # at most the sampled rows: one after the other until their bytes reach the bound
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.partitionBy("label").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    texts = texts.withColumn("bytes", size).where(F.col("bytes") <= max_bytes // 2)
    return materialize(texts.select(F.col("doc_id").cast("long"), "label", "text").mapInArrow(bv.lean(run), _EXAMPLES), "examples")


def _bags(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and count of all words of these examples."""
    h = batch.column(2).to_pylist()
    owner = np.repeat(np.arange(len(h), dtype=np.int32), [len(x) // 8 for x in h])
    return owner, np.frombuffer(b"".join(h), np.uint64), np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int32)


def _in_one_task(examples: DataFrame, folder: str, build) -> tuple:
    """What ``build`` makes of the bounded table of examples, saved, and what it reports: (path, report)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        table = pa.Table.from_batches(got).sort_by("doc_id") if got else None
        made, report = build(table) if table is not None else (None, [])
        yield pa.RecordBatch.from_arrays([pa.array([save(made, folder)]), pa.array([list(report)], pa.list_(pa.int64()))], names=["path", "report"])

    return tuple(examples.coalesce(1).mapInArrow(bv.lean(run), "path string, report array<long>").collect()[0])


def _vocabulary(table: pa.Table) -> tuple[tuple, list[int]]:
    """Sorted hashes of all words of the examples and in how many toxic and other examples each is; reported: toxic and other examples, words."""
    owner, h, _ = _bags(table)
    words, term = np.unique(h, return_inverse=True)
    y = table.column(1).to_numpy()
    toxic, seen = np.bincount(term, y[owner], len(words)), np.bincount(term, minlength=len(words))
    return (words, toxic, seen - toxic), [int(y.sum()), int((1 - y).sum()), len(words)]


def document_counts(docs: DataFrame, vocabulary: str, n_words: int, text: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, of rows with each word of the saved vocabulary, and of (row, other word) pairs by counter."""
    slots = 1 + n_words + OTHERS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = bv.HashSet(load(vocabulary)[0]), np.zeros(-(-slots // PART) * PART, np.uint32)
        for batch in batches:
            total[0] += batch.num_rows
            for _, _, _, h, _ in _texts(batch.column(0)):
                at, term = known.find(h)
                slot = 1 + n_words + (h & np.uint64(OTHERS - 1)).astype(np.int64)
                slot[at] = 1 + term
                # a slot is a text's word or one of several that share it
                slot, n = np.unique(slot, return_counts=True)
                total[slot] += n.astype(np.uint32)
        if total[0]:
            rows = total.reshape(-1, PART)
            at = np.flatnonzero(rows.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([rows[k].tobytes() for k in at], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[part] = total.get(part, np.zeros(PART, np.int64)) + np.frombuffer(raw, np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "counts"])

    # fixed numbers of counters: a task sends those it has used, and the driver gets each one once
    schema = "part long, counts binary"
    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(bv.lean(count), schema)
    got = parts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part").mapInArrow(bv.lean(add), schema).collect()
    total = np.zeros(-(-slots // PART) * PART, np.int64)
    for part, raw in got:
        total[part * PART : (part + 1) * PART] = np.frombuffer(raw, np.int64)
    return int(total[0]), total[1 : 1 + n_words], total[1 + n_words : slots]


def lift(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Log odds ratio of words in so many of the two classes' examples, less its error; not negative."""
    a, b, c, d = toxic + 0.5, n_toxic - toxic + 0.5, other + 0.5, n_other - other + 0.5
    return np.maximum(0.0, np.log(a * d / (b * c)) - DEVIATIONS * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", positives: int = 2000, negatives: int = 6000, max_bytes: int = 48 << 20, neighbours: int = 15) -> tuple[str | None, float, tuple[np.ndarray, np.ndarray]]:
    """(path of the model, base rate, calibration); no path without examples of both classes.

    The model's size is bounded by the examples' number and bytes; one task builds it, and the
    driver sees no more of it than a counter for each word.
    """
    spark = docs.sparkSession
    folder = scratch.new_path(spark, "toxicity")
    sample = materialize(sample_labels(labels, doc_id, label, positives, negatives), "sample")
    examples = _examples(docs, sample, text, doc_id, max_bytes)
    vocabulary, report = _in_one_task(examples, folder, _vocabulary)
    n_toxic, n_other, n_words = report or (0, 0, 0)
    base = n_toxic / max(1, n_toxic + n_other)
    knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    if not (n_toxic and n_other and n_words):
        return None, base, knots
    rows, df, other = document_counts(docs, vocabulary, n_words, text)
    df, other = df.astype(np.int64), np.minimum(other, rows)

    def build(table: pa.Table) -> tuple[Model, list[int]]:
        words, toxic, clean = load(vocabulary)
        idf = lambda f: np.log((1 + rows) / (1 + f)) + 0.1
        model = Model(words, idf(df) * (FLOOR + lift(toxic, clean, n_toxic, n_other)), idf(other), base, neighbours)
        owner, h, n = _bags(table)
        model.index = BlockMaxIndex(*model.vectors(bv.HashSet(words), owner, h, n, table.num_rows), table.column(0).to_numpy(), table.column(1).to_numpy(), len(words))
        return model, []

    path, _ = _in_one_task(examples, folder, build)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        known = bv.HashSet(model.words)
        for batch in batches:
            found = model.votes(*model.vectors(known, *_bags(batch), batch.num_rows), batch.num_rows, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v for v, _ in found])], names=["doc_id", "label", "vote"])

    raw = sorted(examples.repartition(max(1, (n_toxic + n_other) // 500)).mapInArrow(bv.lean(votes), "doc_id long, label int, vote double").collect())
    scratch.drop_tables(sample, examples)
    return path, base, isotonic(np.array([r[2] for r in raw]), np.array([float(r[1]) for r in raw]))


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", positives: int = 2000, negatives: int = 6000, max_bytes: int = 48 << 20, neighbours: int = 15, threshold: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, n_terms, evidence.

    ``n_terms`` counts the text's distinct words that an example has. ``evidence`` lists the ids
    of the nearest labelled examples, the nearest first.
    """
    path, base, knots = fit(docs, labels, text, doc_id, label, positives, negatives, max_bytes, neighbours)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path) if path else None
        known = bv.HashSet(model.words) if model else None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            s, sizes, lists = np.full(len(ids), base), np.zeros(len(ids), np.int32), [[]] * len(ids)
            for i, j, doc, h, n in _texts(batch.column(2)) if model else ():
                o, t, w = model.vectors(known, doc, h, n, j - i)
                full = np.bincount(doc, minlength=j - i) > 0
                sizes[i:j] = np.bincount(o, minlength=j - i)
                got = model.votes(o, t, w, j - i, ids[i:j])
                for k in np.flatnonzero(full):
                    vote, near = got[k]
                    s[i + k], lists[i + k] = np.interp(vote, *knots), model.index.ids[near].tolist()
            s = np.clip(s, 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(sizes), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "held_out", "score", "predicted", "n_terms", "evidence"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(bv.lean(run), f"doc_id {kind}, held_out boolean, score double, predicted int, n_terms int, evidence array<long>")

"""URL filter: host and path rules first, a character language-model ratio for the rest.

Host and path are cut by one expression each, and the longest fitting rule decides. The
distinct urls that rules allow and block are the accepted and rejected examples. A fifth of
them, by hash, is held out; all others are counted, with partial aggregation, into one Markov
model a class over url bytes. Orders 0 to ``ORDER`` are mixed by Witten-Bell smoothing; a
context never seen falls back to the next shorter one, so the order varies with the evidence.
Tables of at most ``MAX_GRAMS`` n-grams travel to the workers, larger ones are joined by
shuffles, with equal scores (to rounding). A url without a rule is blocked when its
log-likelihood difference per byte, accepted minus rejected, is below the multiple of
1 / ``STEPS`` that separates all held-out examples best (balanced accuracy). A class without a
held-out or a counted example uses all it has for both.

Defined results: a url that is null or has no ``://`` has empty host and path, fits no rule,
and is judged by the models as it is (null as empty). Without examples of both classes the
difference is 0 and the verdict allow. Null ids pass through, repeated rows give repeated
results, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import bytesvec as bv
from .scratch import materialize

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
ORDER, MAX_GRAMS, STEPS = 4, 1_000_000, 4096
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Number of the longest fitting rule, or null."""
    out = None
    for i in sorted(range(len(rules)), key=lambda i: -len(rules[i][1] + rules[i][2])):
        _, h, p = rules[i]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, i) if out is None else out.when(fits, i)
    return out if out is not None else F.lit(None).cast("int")


class Markov:
    """Counts of byte n-grams, packed exactly into 64-bit codes, by context length."""

    def __init__(self, urls: list[bytes], order: int = ORDER):
        buf, at = frame(urls, order)
        self._fill([np.unique(codes(buf, at, k), return_counts=True) for k in range(order + 1)])

    @classmethod
    def of_counts(cls, grams: list[tuple[np.ndarray, np.ndarray]]) -> Markov:
        """A model of sorted n-grams and their counts, by context length."""
        self = cls.__new__(cls)
        self._fill(grams)
        return self

    def _fill(self, grams: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.order = len(grams) - 1
        self.tables = []
        for gram, count in grams:
            context, first = np.unique(gram >> np.uint64(8), return_index=True)
            self.tables.append((gram, count, context, np.add.reduceat(count, first), np.diff(np.append(first, len(gram)))))

    def log_probs(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        p = np.full(len(at), 1 / 256)
        for k, (gram, count, context, total, kinds) in enumerate(self.tables):
            g = codes(buf, at, k)
            c = np.where((x := _find(gram, g)) >= 0, count[x], 0)
            x = _find(context, g >> np.uint64(8))
            n, t = np.where(x >= 0, total[x], 0), np.where(x >= 0, kinds[x], 0)
            p = np.where(n > 0, (c + t * p) / np.maximum(n + t, 1), p)
        return np.log(p)


def _find(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    x = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return np.where(values[x] == wanted, x, -1)


def frame(urls: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Urls between start and end bytes, and the places that models predict."""
    start = b"\2" * order
    buf = np.frombuffer(b"".join(start + u + b"\3" for u in urls), np.uint8)
    sizes = np.array([len(u) + order + 1 for u in urls], np.int64)
    inside = np.ones(len(buf), bool)
    first = np.cumsum(sizes) - sizes
    for k in range(order):
        inside[first + k] = False
    return buf, np.flatnonzero(inside)


def codes(buf: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The byte at each place after its k predecessors, as one number."""
    out = np.zeros(len(at), np.uint64)
    for o in range(k, -1, -1):
        out = out << np.uint64(8) | buf[at - o].astype(np.uint64)
    return out


def difference(models: tuple[Markov, Markov], urls: list[bytes]) -> np.ndarray:
    """Log-likelihood difference per byte of the accepted and the rejected model."""
    out = np.zeros(len(urls))
    for k in range(0, len(urls), 4096):
        part = urls[k : k + 4096]
        buf, at = frame(part, models[0].order)
        sizes = np.array([len(u) + 1 for u in part])
        d = models[0].log_probs(buf, at) - models[1].log_probs(buf, at)
        out[k : k + 4096] = np.add.reduceat(d, np.cumsum(sizes) - sizes) / sizes
    return out


def grams_of(examples: DataFrame, order: int = ORDER) -> DataFrame:
    """ok, k, gram, count of the n-grams of all urls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ok in (True, False):
                urls = [u.encode() for u, o in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if o == ok]
                if not urls:
                    continue
                buf, at = frame(urls, order)
                for k in range(order + 1):
                    gram, count = np.unique(codes(buf, at, k), return_counts=True)
                    n = len(gram)
                    yield pa.RecordBatch.from_arrays([pa.array([ok] * n), pa.array(np.full(n, k, np.int32)), pa.array(gram.astype(np.int64)), pa.array(count)], names=["ok", "k", "gram", "count"])

    return examples.select("url", "ok").mapInArrow(bv.lean(run), "ok boolean, k int, gram long, count long").groupBy("ok", "k", "gram").agg(F.sum("count").alias("count"))


def _by_models(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """``rows`` with score, from models that travel to the workers."""
    got = grams.toPandas().sort_values(["k", "gram"], kind="stable")
    models = tuple(Markov.of_counts([(x["gram"].to_numpy().astype(np.uint64), x["count"].to_numpy()) for k in range(ORDER + 1) for x in [got[(got["ok"] == ok) & (got["k"] == k)]]]) for ok in (True, False))
    at = rows.columns.index("url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = difference(models, [(u or "").encode() for u in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, "score"])

    return rows.mapInArrow(bv.lean(run), ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", score double")


def _by_joins(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """``rows`` with score, from joins with n-grams of any number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u in batch.column(0).to_pylist():
                buf, at = frame([u.encode()], ORDER)
                n = len(at)
                gram = np.concatenate([codes(buf, at, k) for k in range(ORDER + 1)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([u] * len(gram)), pa.array(np.tile(np.arange(n), ORDER + 1)), pa.array(np.repeat(np.arange(ORDER + 1, dtype=np.int32), n)), pa.array(gram)], names=["url", "pos", "k", "gram"])

    asked = rows.select(F.coalesce("url", F.lit("")).alias("url")).distinct().mapInArrow(bv.lean(run), "url string, pos long, k int, gram long")
    context = F.shiftright("gram", 8).alias("context")
    count = lambda ok: F.sum(F.when(F.col("ok") == ok, F.col("count")).otherwise(0))
    kinds = lambda ok: F.sum(F.when(F.col("ok") == ok, 1).otherwise(0))
    seen = grams.groupBy("k", "gram").agg(count(True).alias("ca"), count(False).alias("cr"))
    after = grams.groupBy("k", context).agg(count(True).alias("na"), kinds(True).alias("ta"), count(False).alias("nr"), kinds(False).alias("tr"))
    x = asked.select("*", context).join(seen, ["k", "gram"], "left").join(after, ["k", "context"], "left").fillna(0)
    x = x.groupBy("url", "pos").agg(F.sort_array(F.collect_list(F.struct("k", "ca", "na", "ta", "cr", "nr", "tr"))).alias("x"))
    mix = lambda p, c, n, t: F.when(n > 0, (c + t * p) / F.greatest(n + t, F.lit(1))).otherwise(p)
    p = lambda c, n, t: F.aggregate("x", F.lit(1 / 256), lambda p, r: mix(p, r[c], r[n], r[t]))
    score = x.groupBy(F.col("url").alias("__url")).agg(F.avg(F.log(p("ca", "na", "ta")) - F.log(p("cr", "nr", "tr"))).alias("score"))
    return rows.join(score, F.coalesce("url", F.lit("")) == F.col("__url")).drop("__url")


def threshold_of(bins: list[tuple[bool, int, int]]) -> float:
    """Best cut between accepted and rejected examples, the one nearest 0 if several: (accepted, step, examples)."""
    steps = np.array(sorted({b for _, b, _ in bins}))
    counts = [np.zeros(len(steps)) for _ in range(2)]
    for ok, b, n in bins:
        counts[ok][np.searchsorted(steps, b)] += n
    bad, good = (np.concatenate(([0], np.cumsum(c))) / c.sum() for c in counts)
    cuts = np.append(steps, steps[-1] + 1) / STEPS
    gain = bad - good
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    # within an empty stretch between two groups of examples, any cut is as good: the middle
    middle = np.concatenate(([cuts[0]], (np.floor((steps[:-1] + 1 + steps[1:]) / 2)) / STEPS, [cuts[-1]]))
    return float(middle[best[np.argmin(np.abs(middle[best]))]])


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, max_grams: int = MAX_GRAMS) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score."""
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    p = p.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules).cast("int"))
    verdicts = [v for v, _, _ in rules]
    accept = F.col("rule").isin([i for i, v in enumerate(verdicts) if v == "allow"])
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    some = materialize(p.where(F.col("rule").isNotNull()).select("url", accept.alias("ok")).distinct().withColumn("held", held), "urls")
    sizes = {(r["ok"], r["held"]): r["count"] for r in some.groupBy("ok", "held").count().collect()}
    score, threshold = None, 0.0
    if all(any((ok, h) in sizes for h in (True, False)) for ok in (True, False)):
        part = lambda h: some.where(F.col("ok").isin([ok for ok in (True, False) if (ok, h) not in sizes]) | (F.col("held") == h))
        grams = materialize(grams_of(part(False)), "grams")
        score = _by_models if grams.count() <= max_grams else _by_joins
        bins = score(part(True), grams).groupBy("ok", F.floor(F.col("score") * STEPS).alias("b")).count().collect()
        threshold = threshold_of([(r["ok"], r["b"], r["count"]) for r in bins])
    out = score(p, grams) if score else p.withColumn("score", F.lit(0.0))
    named = lambda values: F.coalesce(F.lit(None).cast("string"), *(F.when(F.col("rule") == i, v) for i, v in enumerate(values)))
    by_model = F.when(F.col("score") < threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", named([h + path for _, h, path in rules]).alias("rule"), F.coalesce(named(verdicts), by_model).alias("verdict"), "score")

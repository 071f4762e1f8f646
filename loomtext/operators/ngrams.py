"""Word n-grams within sentences and within runs of content words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.stem import stem_terms
from ..functions.stopwords import is_stopword


def ngrams(tokens: DataFrame, n: int, run: list[str]) -> DataFrame:
    """Rows (doc_id, ngram), one for each run of n words that stay within the columns ``run``."""
    order = Window.partitionBy("doc_id", *[c for c in run if c != "doc_id"]).orderBy("pos")
    parts: list[Column] = [F.col("w")] + [F.lead("w", k).over(order) for k in range(1, n)]
    return tokens.select("doc_id", F.concat_ws(" ", *parts).alias("ngram"), (parts[-1]).alias("__last")).where("__last is not null").drop("__last")


def ngram_counts(grams: DataFrame) -> DataFrame:
    """ngram, cnt, df."""
    by_doc = grams.groupBy("ngram", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    return by_doc.groupBy("ngram").agg(F.sum("c").alias("cnt"), F.count(F.lit(1)).alias("df"))


def content_runs(tokens: DataFrame, is_stop: Column) -> DataFrame:
    """Tokens that aren't stopwords, with the number of their run between stopwords of a sentence."""
    w = Window.partitionBy("doc_id", "sent").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = tokens.withColumn("stop", is_stop.cast("int")).withColumn("run", F.sum("stop").over(w))
    return t.where("stop = 0").drop("stop")


def content_ngrams(tokens: DataFrame, sizes: tuple[int, ...] = (1, 2, 3), stemmed: bool = False) -> DataFrame:
    """size, ngram, cnt of the runs between stopwords; one window gives all sizes.

    With ``stemmed`` words are stemmed first, each distinct word once.
    """
    if stemmed:
        stems = stem_terms(tokens.select("w").distinct(), fixpoint=False).select(F.col("w").alias("x"), "stem")
        tokens = tokens.join(stems, F.col("w") == F.col("x")).select("doc_id", "sent", "pos", F.col("stem").alias("w"))
    order = Window.partitionBy("doc_id", "sent", "run").orderBy("pos")
    words = [F.col("w")] + [F.lead("w", k).over(order) for k in range(1, max(sizes))]
    rows = content_runs(tokens, is_stopword(F.col("w"))).select(F.array(*words).alias("ws"))
    grams = F.array(*(F.when(F.element_at("ws", n).isNotNull(), F.struct(F.lit(n).alias("size"), F.array_join(F.slice("ws", 1, n), " ").alias("ngram"))) for n in sizes))
    return rows.select(F.inline(F.filter(grams, lambda g: g.isNotNull()))).groupBy("size", "ngram").agg(F.count(F.lit(1)).alias("cnt"))


def idf_of(df: Column, size: Column, parity: bool = False) -> Column:
    """1 + log2(N / (1 + df)); with ``parity`` the quotient is an integer division."""
    ratio = F.floor(size / (1 + df)).cast("double") if parity else size / (1.0 + df)
    return 1 + F.log2(ratio)

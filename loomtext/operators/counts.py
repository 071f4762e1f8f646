"""Term and document frequencies, IDF and TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def term_counts(tokens: DataFrame) -> DataFrame:
    """doc_id, w, n."""
    return tokens.groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))


def corpus_counts(tokens: DataFrame) -> DataFrame:
    """w, n over the corpus; partial aggregation carries frequent terms."""
    return tokens.groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    """w, df from (doc_id, w, n): rows are distinct by document, so counting them suffices."""
    return counts.groupBy("w").agg(F.count(F.lit(1)).alias("df"))


def corpus_size(counts: DataFrame) -> DataFrame:
    """One row: n_docs, the documents with at least one term."""
    return counts.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("n_docs"))


def max_counts(counts: DataFrame) -> DataFrame:
    """doc_id, max_n: the count of each document's most frequent term."""
    return counts.groupBy("doc_id").agg(F.max("n").alias("max_n"))


def idf(df: DataFrame, size: DataFrame) -> DataFrame:
    """w, df, idf = 1 + log2(N / (1 + df)); the one-row size is broadcast."""
    return df.crossJoin(F.broadcast(size)).select("w", "df", (1 + F.log2(F.col("n_docs") / (1.0 + F.col("df")))).alias("idf"))


def tf_idf(counts: DataFrame, df: DataFrame, size: DataFrame) -> DataFrame:
    """doc_id, w, n, tf, idf, score: tf = 0.5 + 0.5 n / max n, idf = log2(N / (1 + df)).

    Frequencies join on the term; the largest count comes from a window, as rows of a
    document fit one partition.
    """
    most = F.max("n").over(Window.partitionBy("doc_id"))
    t = counts.withColumn("tf", 0.5 + 0.5 * F.col("n") / most)
    i = df.crossJoin(F.broadcast(size)).select("w", F.log2(F.col("n_docs") / (1.0 + F.col("df"))).alias("idf"))
    return t.join(i, "w").select("doc_id", "w", "n", "tf", "idf", (F.col("tf") * F.col("idf")).alias("score"))


def top_terms(scores: DataFrame, k: int) -> DataFrame:
    """The k best rows of each document, ties by term; the plan limits groups before the shuffle."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "w")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def good_turing(counts: DataFrame, small: int = 5) -> DataFrame:
    """r, n_r, p: probability of a term seen r times; r up to ``small`` by (r+1) N(r+1) / N(r) / total."""
    of = counts.groupBy(F.col("n").alias("r")).agg(F.count(F.lit(1)).alias("n_r"))
    total = counts.agg(F.sum("n").alias("total"))
    up = of.select((F.col("r") - 1).alias("r"), F.col("n_r").alias("n_up"))
    p = F.when(F.col("r") <= small, (F.col("r") + 1) * F.coalesce("n_up", F.lit(0)) / F.col("n_r") / F.col("total")).otherwise(F.col("r") / F.col("total"))
    return of.join(up, "r", "left").crossJoin(F.broadcast(total)).select("r", "n_r", p.alias("p"))

"""The registered queries of this subpackage; SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    found = decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))[0]


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.taken(_table(spark, sf_dir, "documents")).drop("source")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op8_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import wavelet

    return wavelet.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urlfilter

    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    return licenses.scan(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_topk, op2_decontamination, op3_near_duplicates, op4_toxicity, op5_language, op6_mixing, op7_warc, op8_wavelet, op9_urls, op10_licenses)
}

ORACLES: dict[str, str] = {"op1_topk": topk.ORACLE, "op7_warc": warc.ORACLE}

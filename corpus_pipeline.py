"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of documents, and
further columns that there are, whatever their names. Each stage makes an empty table of an
empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import decontam, jaccard, langid, mixing, scratch, wavelet

#: Vocabulary file of the last stage.
TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which no language can be identified.

    Null, empty and letterless texts go, and texts whose score is below the one at which held-out
    documents are identified wrongly rather than rightly. Where that can't be told (no or hardly
    any held-out row has a language, or the network is mostly wrong), every text with a letter
    stays, and also where no row has a language to learn from. Rows with null ids, repeated rows
    and rows with null in other columns are kept or dropped by their text alone.
    """
    model = langid.fit(docs)
    return langid.keep_identified(docs, model, min_score=langid.calibrate(docs, model))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of exact and near copies.

    Of rows that share an id the one with the smallest text stays. Rows with a null id are
    compared with none and stay, as do documents without words, each a group of its own.
    """
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.

    Null and empty texts hold none; items that are null, empty or too short are held by none.
    Rows are judged by their text alone, so repeated rows share their fate.
    """
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each text by the words that the mix of sources takes of it.

    Documents of which no word is taken, null and empty texts among them, go. A null source is a
    source. Null ids and repeated rows are mixed like others.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token shards and report each document as read back from them.

    A null text has only the end token. Null ids come first; equal ids are ordered by text.
    """
    return wavelet.round_trip(docs, public_tokenizers.path(TOKENIZER))


_previous: list[str] = []


def _tidy(stage):
    """Delete the scratch of the stage before, whose result is written by now, then run this one."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.drop(spark, *_previous)
        before = scratch.made()
        out = stage(spark, docs, sf_dir)
        _previous[:] = [p for p in scratch.made() if p not in before]
        return out

    return run


STAGES = [(f.__name__, _tidy(f)) for f in (language, near_duplicates, decontaminate, mix, tokens)]

#: The language model, the random draws and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch.new_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs

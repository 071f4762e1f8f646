"""Readers: all are Spark scans, so files are split, listed and retried by the scheduler."""

from __future__ import annotations

from importlib import resources

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .staging import stage


def corpus(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """path, content of the files below a directory, whole and as text."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(directory)
    return df.select("path", F.decode("content", "UTF-8").alias("content"))


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("line"))


def json_map(df: DataFrame, column: str, value: str = "double") -> DataFrame:
    """term, value rows of JSON objects in a column."""
    return df.select(F.explode(F.from_json(F.col(column), f"map<string,{value}>")).alias("term", "value"))


def scores_json(spark: SparkSession, path: str) -> DataFrame:
    """term, score of a file with one JSON object."""
    return json_map(spark.read.text(path, wholetext=True), "value").withColumnRenamed("value", "score")


def counts_json(spark: SparkSession, path: str, size_key: str = "__corpus_size") -> DataFrame:
    """term, n; the entry that holds the number of documents is left out."""
    return json_map(spark.read.text(path, wholetext=True), "value", "bigint").withColumnRenamed("value", "n").where(F.col("term") != size_key)


def nested_json(spark: SparkSession, path: str, value: str = "double") -> DataFrame:
    """doc, term, value of a file with an object of objects."""
    docs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,map<string,{value}>>")).alias("doc", "m"))
    return docs.select("doc", F.explode("m").alias("term", "value"))


def ngram_list(spark: SparkSession, path: str) -> DataFrame:
    """ngram, id: the line's number from 0 among lines that aren't blank; ids follow file order.

    Lines are numbered within the blocks that tasks read; only the blocks' sizes are ordered as a whole.
    """
    lines = spark.read.text(path).select(F.col("value").alias("ngram"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m")).where(F.trim("ngram") != "")
    lines = stage(lines, "lines")
    sizes = lines.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("f", "b", F.coalesce(F.sum("n").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("f", "b").orderBy("m")) - 1
    return lines.withColumn("r", number).join(base, ["f", "b"]).select("ngram", (F.col("base") + F.col("r")).cast("bigint").alias("id")).sort("id")


def language_model(spark: SparkSession, path: str, size: int = 400) -> DataFrame:
    """lang, gram, rank of files ``<lang>.lm`` with lines gram, tab, count."""
    df = spark.read.csv(path, sep="\t", schema="gram string, n bigint", quote="").select("*", F.regexp_extract(F.input_file_name(), r"([^/]+)\.lm$", 1).alias("lang"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("lang", "gram", "rank")


def word_map(spark: SparkSession, path: str) -> DataFrame:
    """term_id, term of a file with a number and a word on each line."""
    return spark.read.csv(path, sep=" ", schema="term_id bigint, term string", quote="")


def encoded(spark: SparkSession, path: str) -> DataFrame:
    """path, label, pos, term_id of lines ``label id id ...``."""
    parts = spark.read.text(path).select(F.input_file_name().alias("path"), F.split(F.trim("value"), " +").alias("x"))
    return parts.select("path", F.col("x")[0].cast("int").alias("label"), F.posexplode(F.slice("x", F.lit(2), F.size("x"))).alias("pos", "t")).select("path", "label", "pos", F.col("t").cast("bigint").alias("term_id"))


def libsvm(spark: SparkSession, path: str) -> DataFrame:
    """line, label, idx, val of libsvm text."""
    parts = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), " +").alias("x"))
    f = parts.select("line", F.col("x")[0].cast("double").cast("int").alias("label"), F.explode(F.slice("x", F.lit(2), F.size("x"))).alias("f"))
    return f.select("line", "label", F.split("f", ":")[0].cast("int").alias("idx"), F.split("f", ":")[1].cast("double").alias("val"))


def path_parts(path: Column) -> Column:
    """dir, name, ext of a path, as a struct."""
    return F.struct(F.regexp_extract(path, r"^(.*/)?[^/]*$", 1).alias("dir"), F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1).alias("name"), F.regexp_extract(path, r"\.([^./]*)$", 1).alias("ext"))


def resource(name: str) -> str:
    """Path of a file inside this package."""
    return str(resources.files("loomtext").joinpath(name))


def well_formed(docs: DataFrame, column: str, on_error: str = "null") -> DataFrame:
    """``docs`` with malformed XML as null, or an error naming how many there are."""
    from ..functions.dom import parse

    @F.pandas_udf("boolean")
    def ok(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t is not None and parse(t, strict=True) is not None)

    checked = docs.withColumn("__ok", ok(F.col(column)))
    if on_error == "fail":
        bad = F.when(~F.col("__ok"), F.raise_error(F.lit("a document is not well-formed"))).otherwise(F.col(column))
        return checked.withColumn(column, bad).drop("__ok")
    return checked.withColumn(column, F.when(F.col("__ok"), F.col(column))).drop("__ok")

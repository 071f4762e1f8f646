"""Writers: formats of term statistics, features and reports, written by all tasks at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def as_json_object(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: the relation as one JSON object with sorted keys; for dictionaries that fit a row."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key), F.col(value))))
    return df.agg(F.to_json(F.map_from_entries(entries)).alias("value"))


def by_doc_json(df: DataFrame, doc: str, key: str, value: str) -> DataFrame:
    """One row a document: {"doc": .., "terms": {..}} as JSON."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col(value)))))
    return df.groupBy(F.col(doc).alias("doc")).agg(entries.alias("terms")).select(F.to_json(F.struct("doc", "terms")).alias("value"))


def term_rows_json(df: DataFrame, path: str) -> None:
    """The relation as JSON lines, for dictionaries of any size."""
    df.write.mode("overwrite").json(path)


def ngrams_json(df: DataFrame, path: str, size: str = "size") -> None:
    df.write.mode("overwrite").partitionBy(size).json(path)


def text_lines(df: DataFrame, column: str, path: str, single_file: bool = False) -> None:
    out = df.select(F.col(column).cast("string").alias("value"))
    (out.coalesce(1) if single_file else out).write.mode("overwrite").text(path)


def labelled_lines(df: DataFrame, column: str, label: str, path: str) -> None:
    """One directory of text for each label."""
    df.select(F.col(label).alias("label"), F.col(column).alias("value")).write.mode("overwrite").partitionBy("label").text(path)


def dictionary(df: DataFrame, path: str, term_id: str = "term_id", term: str = "w") -> None:
    df.select(term_id, term).write.mode("overwrite").csv(path, sep=" ", quote="")


def report(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, sep=" ")


def rejected(docs: DataFrame, kept: DataFrame, doc_id: str = "doc_id", reason: str = "not English") -> DataFrame:
    """Ids of documents that a filter dropped, with the reason."""
    return docs.select(doc_id).join(kept.select(doc_id), doc_id, "left_anti").withColumn("reason", F.lit(reason))


def job_response(df: DataFrame, annotations: str, log: str, status: str) -> DataFrame:
    """JSON responses {annotations, log, status}."""
    return df.select(F.to_json(F.struct(F.col(annotations).alias("annotations"), F.col(log).alias("log"), F.col(status).alias("status"))).alias("value"))

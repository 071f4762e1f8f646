"""Table access and SQL fragments shared by the plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import stopwords, tokens

Query = Callable[[SparkSession, str], DataFrame]

STOP_SQL = "(" + ",".join("'" + w.replace("'", "''") + "'" for w in stopwords.EXTENDED) + ")"
BASIC_SQL = "(" + ",".join("'" + w.replace("'", "''") + "'" for w in stopwords.BASIC) + ")"

TOK = """tok AS (SELECT doc_id, CAST(generate_subscripts(a, 1) AS INTEGER) AS pos, unnest(a) AS w
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS a FROM documents))"""
PARA = """para AS (SELECT doc_id, CAST(generate_subscripts(p, 1) AS INTEGER) AS para_id, unnest(p) AS para
  FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
ptok AS (SELECT doc_id, para_id, CAST(generate_subscripts(a, 1) AS INTEGER) AS pos, unnest(a) AS w
  FROM (SELECT doc_id, para_id, regexp_extract_all(lower(para), '[a-z]+') AS a FROM para))"""
SENT = r"""stok AS (SELECT doc_id, sent, CAST(generate_subscripts(a, 1) AS INTEGER) AS pos, unnest(a) AS w
  FROM (SELECT doc_id, sent, regexp_extract_all(s, '[a-z]+') AS a
    FROM (SELECT doc_id, generate_subscripts(p, 1) AS sent, unnest(p) AS s
      FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[.!?\n]+') AS p FROM documents))))"""
CNT = "cnt AS (SELECT doc_id, w, count(*) AS n FROM tok GROUP BY doc_id, w)"
DF = "dfq AS (SELECT w, count(*) AS df FROM cnt GROUP BY w)"
SIZE = "sz AS (SELECT count(DISTINCT doc_id) AS n_docs FROM cnt)"
IDF = "idfq AS (SELECT w, df, 1 + log2(n_docs / (1.0 + df)) AS idf FROM dfq, sz)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores: a file with one row group is read by one task otherwise."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if size < cores * (16 << 20) else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def doc_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.terms(documents(spark, sf_dir))


def para_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.paragraph_terms(documents(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label: 1 for quality, else -1."""
    return table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 1).otherwise(-1).alias("label"))


LABELS = "lab AS (SELECT doc_id, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS label FROM labels)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"

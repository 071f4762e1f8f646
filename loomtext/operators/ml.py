"""Splits, subsets and the linear classifier over libsvm-style features."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import MinMaxScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, functions as F


def fold(key: Column, k: int, hashed: bool = True) -> Column:
    """Group 0..k-1 of a row, by the hash of its key or the key itself."""
    return F.pmod(F.xxhash64(key) if hashed else key, F.lit(k)).cast("int")


def subset(df: DataFrame, key: str, size: int) -> DataFrame:
    """``size`` rows in pseudorandom order of the key; one top-k, no full sort."""
    return df.orderBy(F.xxhash64(key), key).limit(size)


def vectors(features: DataFrame, labels: DataFrame, dimensions: int) -> DataFrame:
    """doc_id, label (0 or 1), features: dense vectors of the indexes 1..dimensions."""
    m = features.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("idx").cast("int"), "val"))).alias("m"))
    v = F.transform(F.sequence(F.lit(1), F.lit(dimensions)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return m.select("doc_id", array_to_vector(v).alias("raw")).join(labels.select("doc_id", F.when(F.col("label") > 0, 1.0).otherwise(0.0).alias("label")), "doc_id")


def pipeline(max_iter: int = 20, reg: float = 0.01) -> Pipeline:
    return Pipeline(stages=[MinMaxScaler(inputCol="raw", outputCol="features"), LinearSVC(maxIter=max_iter, regParam=reg)])


def train_predict(train: DataFrame, test: DataFrame, **options) -> DataFrame:
    """doc_id, label, prediction of a scaled linear SVM."""
    return pipeline(**options).fit(train).transform(test).select("doc_id", "label", "prediction")


def cross_validate(data: DataFrame, folds: int = 5, regs: tuple[float, ...] = (0.01, 0.1), seed: int = 7):
    """A fitted cross-validator over the regularisation."""
    p = pipeline()
    grid = ParamGridBuilder().addGrid(p.getStages()[-1].regParam, list(regs)).build()
    return CrossValidator(estimator=p, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=folds, seed=seed).fit(data)

"""Dense numbering of a whole relation without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def number_rows(df: DataFrame, coarse: list[Column], fine: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with 1-based positions in the order of ``coarse`` and then ``fine``.

    ``coarse`` must be a prefix of the order with few distinct values beside the rows: only the
    counts of its groups are ordered as a whole; rows are ordered within their group.
    """
    keys = [c.alias(f"__k{i}") for i, c in enumerate(coarse)]
    names = [f"__k{i}" for i in range(len(coarse))]
    keyed = df.select("*", *keys)
    groups = keyed.groupBy(*names).count()
    before = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select(*names, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__o"))
    inner = F.row_number().over(Window.partitionBy(*names).orderBy(*fine))
    out = keyed.withColumn("__r", inner).join(offsets, names)
    return out.withColumn(name, F.col("__o") + F.col("__r")).drop("__o", "__r", *names)

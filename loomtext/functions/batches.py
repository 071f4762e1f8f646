"""Python functions over rows, a few rows at a time.

Spark hands over Arrow batches of up to 10,000 rows or 64 MB. What is made from them is made for
slices of :data:`SLICE` rows, so that a task holds the Python objects of a slice, not of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import DataType, StructType

#: Rows taken from a batch at a time, and rows made before they are handed on.
SLICE, ROWS = 64, 20_000


def _slices(batch: pa.RecordBatch | pa.Array) -> Iterator:
    for at in range(0, len(batch), SLICE):
        yield batch.slice(at, SLICE)


def each(column: Column, rule: Callable, kind: str) -> Column:
    """``rule`` of each value; nulls go to it as None."""
    out = to_arrow_type(DataType.fromDDL(kind))
    return arrays(column, lambda part: pa.array([rule(x) for x in part.to_pylist()], out), kind)


def arrays(column: Column, of: Callable[[pa.Array], pa.Array], kind: str) -> Column:
    """What ``of`` gives for the values of each slice."""
    out = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            if not len(batch):
                yield pa.array([], out)
            for part in _slices(batch):
                yield of(part)

    return run(column)


def columns(df: DataFrame, of: Callable[..., Iterable[Iterable]], schema: str | StructType) -> DataFrame:
    """The rows whose columns ``of`` gives, again and again, for the columns of a slice of rows, as lists."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                for found in of(*(c.to_pylist() for c in part.columns)):
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(found, out)], schema=out)

    return df.mapInArrow(run, kind)


def rows(df: DataFrame, of: Callable[..., Iterable[tuple]], schema: str | StructType) -> DataFrame:
    """The rows that ``of`` gives for the values of each row."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = to_arrow_schema(kind)

    def made(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for batch in batches:
            for part in _slices(batch):
                for values in zip(*(c.to_pylist() for c in part.columns)):
                    found.extend(of(*values))
                    if len(found) >= ROWS:
                        yield made(found)
                        found = []
        if found:
            yield made(found)

    return df.mapInArrow(run, kind)

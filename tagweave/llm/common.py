"""Helpers shared by the operators of this subpackage: table reading and Arrow kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import bound_batches, cut_lineage, ensure_checkpoint_dir, ship_package, table_path

__all__ = ["arrow_map", "bound_batches", "cut_lineage", "read", "slices", "with_column_schema"]

SLICE_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table (a plain scan)."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    bound_batches(spark)
    return spark.read.parquet(table_path(sf_dir, name)).select(*columns)


def slices(batches: Iterable[pa.RecordBatch], max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into row ranges of about ``max_bytes`` (one row at least)."""
    for b in batches:
        n = b.num_rows
        if n == 0:
            continue
        step = max(1, int(n * max_bytes / max(b.nbytes, 1)))
        for at in range(0, n, step):
            yield b.slice(at, step)


def with_column_schema(df: DataFrame | StructType, name: str, ddl: str) -> StructType:
    """Schema of ``df`` (or the schema itself) with one more column."""
    return StructType([*(df if isinstance(df, StructType) else df.schema).fields, *StructType.fromDDL(f"`{name}` {ddl}").fields])


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[dict]], schema: str,
              max_bytes: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` with a function from a bounded slice to dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    target = to_arrow_schema(StructType.fromDDL(schema))
    # string columns may arrive as large_string; the kernels only read Python values

    def run(batches):
        for b in slices(batches, max_bytes):
            for cols in fn(b):
                yield pa.RecordBatch.from_arrays(
                    [v if isinstance(v, pa.Array) and v.type == f.type else pa.array(v, type=f.type)
                     for f, v in ((f, cols[f.name]) for f in target)], schema=target)

    return df.mapInArrow(run, schema)

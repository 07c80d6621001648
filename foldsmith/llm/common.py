"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


#: Rows of an Arrow batch: long texts then keep a batch near a few megabytes.
BATCH_ROWS = 1024
WORD = "[^\\x20\\x09-\\x0D]+"


def schema_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, Sequence] | None]],
                ddl: str, last: bool = False) -> DataFrame:
    """Run a function on every Arrow batch of ``df``.

    ``make`` is called once a task and returns the function, which gives columns by name; with ``last`` that function
    is called once more with None after the task's last batch.
    """
    target = arrow_schema(ddl)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            columns = step(batch)
            if columns is not None:
                yield pa.RecordBatch.from_arrays([_column(columns[f.name], f.type) for f in target], schema=target)
        if last and (columns := step(None)) is not None:
            yield pa.RecordBatch.from_arrays([_column(columns[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema_of(ddl))


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(schema_of(ddl))


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one small file to any file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(data))
    out.close()

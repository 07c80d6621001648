"""Readers and writers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path
from .schemas import schema_of


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType, sep: str = ",", header: bool = True,
             nan_as_null: bool = True, multiline: bool = False) -> DataFrame:
    """Delimited text with a declared schema.

    ``multiline`` accepts line breaks inside quotes, but then a file cannot be split between tasks.
    NaN becomes NULL: in Spark NaN is the largest number, so ``value >= threshold`` would hold for it.
    """
    df = (spark.read.schema(schema).option("header", header).option("sep", sep)
          .option("quote", '"').option("escape", '"').option("multiLine", multiline).csv(path))
    if not nan_as_null:
        return df
    doubles = {f.name for f in schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in doubles else F.col(c)
                       for c in df.columns])


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists", by: list[str] | None = None) -> None:
    writer = df.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"')
    (writer.partitionBy(*by) if by else writer).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t")


def read_relational(spark: SparkSession, sql: str, tables: dict[str, DataFrame], **params) -> DataFrame:
    """Run ``sql`` with named parameters (``:name``) over tables given by name, whatever they are read from."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=params or None)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int,
              **options: str) -> DataFrame:
    """A database table read in ``parts`` key ranges, so no single task pulls the whole of it."""
    return (spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low,
                                              upperBound=high, numPartitions=parts, fetchsize=10_000, **options).load())


def read_pairs(spark: SparkSession, path: str, names: tuple[str, str] = ("active", "decoy")) -> DataFrame:
    """Blank-separated pair file, one pair a line."""
    schema = schema_of(f"{names[0]} string, {names[1]} string")
    return read_csv(spark, path, schema, sep=" ", header=False, nan_as_null=False)


def read_config_grid(spark: SparkSession, path: str) -> dict[str, list]:
    """A JSON object of parameter lists (single values are taken as lists of one); a small file by nature."""
    row = spark.read.option("multiLine", True).json(path).first().asDict(recursive=True)
    return {k: v if isinstance(v, list) else [v] for k, v in row.items()}


def with_path_parts(df: DataFrame, names: list[str], folder: str | None = None, sep: str = "_") -> DataFrame:
    """Columns read off the name of the file a row came from, or of its ``folder=`` directory.

    The text ``None`` means not applicable and becomes NULL.
    """
    if folder:
        stem = F.regexp_extract(F.col("_metadata.file_path"), f"/{re.escape(folder)}=([^/]*)/", 1)
    else:
        stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    parts = F.split(stem, re.escape(sep))
    return df.select("*", *[F.nullif(F.get(parts, i), F.lit("None")).alias(n) for i, n in enumerate(names)])


def read_union(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames under the union of their columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_partitioned(df: DataFrame, path: str, keys: list[str], mode: str = "errorifexists",
                      files_per_key: int = 1, spread: list[str] | None = None) -> None:
    """A folder tree by ``keys``.

    Rows are gathered by key first, else every task would open a file in every folder; ``files_per_key``
    with ``spread`` (a row id) divides a large key over that many tasks.
    """
    extra = [F.pmod(F.xxhash64(*spread), F.lit(files_per_key))] if spread and files_per_key > 1 else []
    df.repartition(*keys, *extra).write.mode(mode).partitionBy(*keys).parquet(path)


def append_results(df: DataFrame, path: str, run: str) -> None:
    """Add one run's rows to a result store; runs lie in their own folders and never rewrite each other."""
    df.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)


def rewrite_with(df: DataFrame, columns: dict, label: str) -> DataFrame:
    """A new version of a stored dataset with columns added, written beside the old one and read back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    new = df.withColumns(columns)
    new.write.parquet(path)
    return spark.read.schema(new.schema).parquet(path)

"""Result stores and dataset versions that a repeated or interrupted write neither doubles nor damages.

A write goes to a folder of its own, which nothing reads until a pointer names it.  The pointer, a one-line file, is
written aside and renamed into place without overwriting, which a Hadoop file system with an atomic rename (HDFS) lets
one writer do once; a local disk looks and renames in two steps, an instant apart.  Readers see the old state or the new one, never a part.  Folders of writes that
lost or broke off stay unread; :func:`abandoned` names them, so that they can be deleted once no write is running.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CommitConflict(RuntimeError):
    """Another writer committed the version first."""


def _path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, folder: str) -> list[str]:
    """Names directly under ``folder``, none where it does not exist; a few per run or version."""
    path = _path(spark, folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def _point(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Put ``text`` under ``folder``/``name`` unless something is there already."""
    conf, aside = spark.sparkContext._jsc.hadoopConfiguration(), _path(spark, f"{folder}-aside/{uuid.uuid4().hex}")
    fs = aside.getFileSystem(conf)
    out = fs.create(aside, False)
    out.write(bytearray(f"{text}\n", "utf-8"))
    out.close()
    fs.mkdirs(_path(spark, folder))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        hadoop.FileContext.getFileContext(aside.toUri(), conf).rename(aside, _path(spark, f"{folder}/{name}"), none)
    except Py4JJavaError as failed:
        fs.delete(aside, False)
        if failed.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


def _pointed(spark: SparkSession, folder: str, name: str) -> str:
    return spark.read.text(f"{folder}/{name}").first()["value"]


def _write(df: DataFrame, path: str) -> str:
    attempt = f"attempt-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/data/{attempt}")
    return attempt


def commit_run(df: DataFrame, path: str, run: str) -> bool:
    """Add the rows of ``run`` to the store under ``path``, whole and once.

    False, and nothing changes, where the run is there already, also when another writer of it ends first.  A run without
    rows is a run.  A column ``run`` of ``df`` is refused, as it would hide the key.
    """
    if "run" in df.columns:
        raise ValueError("the column run is the store's own")
    spark, name = df.sparkSession, quote(run, safe="") + ".run"
    if name in _files(spark, f"{path}/runs"):
        return False
    return _point(spark, f"{path}/runs", name, _write(df.withColumn("run", F.lit(run)), path))


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all committed runs, with the column ``run``; columns a run lacks are missing in its rows."""
    if not _files(spark, f"{path}/runs"):
        return spark.createDataFrame([], f"{schema}, run string")
    attempts = [r["value"] for r in spark.read.text(f"{path}/runs").collect()]  # one short line a run
    return spark.read.schema(f"{schema}, run string").parquet(*[f"{path}/data/{a}" for a in attempts])


def latest_version(spark: SparkSession, path: str) -> int | None:
    """Number of the newest version, None for a dataset without any."""
    numbers = [int(n.split(".")[0]) for n in _files(spark, f"{path}/versions") if n.endswith(".version")]
    return max(numbers, default=None)


def commit_version(df: DataFrame, path: str, based_on: int | None) -> int:
    """Write ``df`` as the version after ``based_on`` (None: the first) and return its number.

    ``df`` may read any version of the same dataset, as those are never touched.  :class:`CommitConflict` where that
    number is taken: the writer should read the newest version and do its work again.
    """
    spark, number = df.sparkSession, 0 if based_on is None else based_on + 1
    name = f"{number:012d}.version"
    if name in _files(spark, f"{path}/versions") or not _point(spark, f"{path}/versions", name, _write(df, path)):
        raise CommitConflict(f"version {number} of {path} is there already")
    return number


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The given version, by default the newest."""
    number = latest_version(spark, path) if version is None else version
    if number is None:
        raise ValueError(f"{path} has no version")
    return spark.read.parquet(f"{path}/data/{_pointed(spark, f'{path}/versions', f'{number:012d}.version')}")


def rewrite_version(spark: SparkSession, path: str, change, tries: int = 3) -> int:
    """Commit ``change(newest version)`` as the next version; if another writer was first, change what they wrote."""
    for left in range(tries - 1, -1, -1):
        number = latest_version(spark, path)
        try:
            return commit_version(change(read_version(spark, path, number)), path, number)
        except CommitConflict:
            if not left:
                raise
    raise ValueError("tries must be positive")


def abandoned(spark: SparkSession, path: str) -> list[str]:
    """Folders of writes that no pointer names: broken off, beaten by another writer, or still being written."""
    named = set()
    for kind in ("runs", "versions"):
        if _files(spark, f"{path}/{kind}"):
            named |= {r["value"] for r in spark.read.text(f"{path}/{kind}").collect()}
    return [f"{path}/data/{a}" for a in _files(spark, f"{path}/data") if a not in named]

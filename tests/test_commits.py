import threading

import pytest
from pyspark.sql import functions as F

from foldsmith.sources import commits as C


@pytest.fixture
def store(tmp_path):
    return str(tmp_path / "store")


def runs(spark, store):
    return sorted((r["run"], r["n"]) for r in C.read_runs(spark, store, "n long").groupBy("run").agg(F.count("n").alias("n")).collect())


def broken(spark, rows=1000):
    """A frame that fails after some of its tasks have written."""
    return spark.range(0, rows, 1, 8).select(F.when(F.col("id") < rows - 1, F.col("id"))
                                             .otherwise(F.raise_error(F.lit("broken off")).cast("long")).alias("n"))


def test_a_repeated_run_counts_once(spark, store):
    assert C.read_runs(spark, store, "n long").count() == 0
    df = spark.range(5).select(F.col("id").alias("n"))
    assert C.commit_run(df, store, "a/b: 1")
    assert not C.commit_run(df, store, "a/b: 1")
    assert C.commit_run(df.limit(2), store, "second")
    assert runs(spark, store) == [("a/b: 1", 5), ("second", 2)]
    assert C.abandoned(spark, store) == []
    with pytest.raises(ValueError):
        C.commit_run(df.withColumn("run", F.lit(1)), store, "third")


def test_an_interrupted_run_leaves_nothing_and_can_be_repeated(spark, store):
    C.commit_run(spark.range(3).select(F.col("id").alias("n")), store, "first")
    with pytest.raises(Exception, match="broken off"):
        C.commit_run(broken(spark), store, "second")
    assert runs(spark, store) == [("first", 3)]
    assert len(C.abandoned(spark, store)) == 1
    assert C.commit_run(spark.range(999).select(F.col("id").alias("n")), store, "second")
    assert runs(spark, store) == [("first", 3), ("second", 999)]


def test_of_writers_at_once_one_wins(spark, store):
    won = []

    def write(rows):
        won.extend([rows] if C.commit_run(spark.range(rows).select(F.col("id").alias("n")), store, "same") else [])

    writers = [threading.Thread(target=write, args=(n,)) for n in (10, 20, 30, 40)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert len(won) == 1 and runs(spark, store) == [("same", won[0])]


def test_a_run_that_ends_between_look_and_rename_loses(spark, store, monkeypatch):
    df = spark.range(4).select(F.col("id").alias("n"))
    C.commit_run(df, store, "r")
    monkeypatch.setattr(C, "_files", lambda *_: [])  # the look finds nothing, as if the other had not ended yet
    assert not C.commit_run(df, store, "r")
    monkeypatch.undo()
    assert runs(spark, store) == [("r", 4)]
    assert len(C.abandoned(spark, store)) == 1


def test_versions_are_kept_and_conflicts_found(spark, store):
    assert C.latest_version(spark, store) is None
    with pytest.raises(ValueError):
        C.read_version(spark, store)
    assert C.commit_version(spark.range(6), store, None) == 0
    assert C.rewrite_version(spark, store, lambda old: old.withColumn("even", F.col("id") % 2 == 0)) == 1
    assert C.read_version(spark, store).columns == ["id", "even"]
    assert C.read_version(spark, store, 0).columns == ["id"]
    with pytest.raises(C.CommitConflict):
        C.commit_version(spark.range(1), store, 0)
    with pytest.raises(Exception, match="broken off"):
        C.rewrite_version(spark, store, lambda old: broken(spark))
    assert C.latest_version(spark, store) == 1 and C.read_version(spark, store).count() == 6


def test_a_rewrite_takes_up_what_came_between(spark, store):
    C.commit_version(spark.range(3), store, None)
    seen = []

    def add(old):
        if not seen:  # another writer comes first
            C.commit_version(spark.range(10), store, 0)
        seen.append(old.count())
        return old.withColumn("more", F.lit(1))

    assert C.rewrite_version(spark, store, add) == 2
    assert seen == [3, 10] and C.read_version(spark, store).count() == 10

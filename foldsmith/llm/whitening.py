"""Whitening of embeddings over their distinct vectors, by a weighted multiplicity covariance.

Entries are put on a grid (``floor(scale * entry)``), so equal vectors can be grouped.  Each distinct vector is kept once
with its multiplicity, which weighs the fit (or one does).  Sums are exact integers; a second pass centres the vectors,
block by block, and multiplies them, weighted, as matrices; one task's products are added before they move, and rows of
the matrices meet in separate groups.  The driver sees a matrix as wide as a vector, whatever the number of rows.  Each
distinct vector is whitened once and joined back to the rows that hold it; vectors with many rows are spread.

Vectors of another length are a set of their own, whitened by themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, materialize, spread
from .common import map_batches

#: A vector that holds more than this share of all rows is spread; there can be at most as many as the number says.
SHARES = 1000
#: Variances below this share of the whole are rounding: there is nothing to scale up.
LEAST_SHARE = 1e-10
WIDEST = 1 << 53  # integers up to here are exact as doubles


def on_grid(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, x) of the rows whose vector has entries, all finite; an entry beyond 2^53 counts as 2^53."""
    bound = float(WIDEST)
    entry = lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(bound)), F.lit(-bound)))
    unfit = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
            .filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(unfit, F.lit(True)))
            .select("id", F.transform("v", entry).alias("x")))


def keyed(rows: DataFrame) -> DataFrame:
    """Two 64-bit hashes of ``x`` stand for it (k1, k2): 128 bits, so that different vectors do not meet."""
    return rows.withColumn("k1", F.xxhash64(F.lit(1), F.size("x"), "x")).withColumn("k2", F.xxhash64(F.lit(2), F.size("x"), "x"))


def matrix_of(column: pa.Array, at: np.ndarray) -> np.ndarray:
    """The rows ``at`` of a column of vectors, which have one length, as a matrix."""
    return column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)


def _by_dims(batch: pa.RecordBatch):
    dims = batch.column("dims").to_numpy()
    for d in np.unique(dims).tolist():
        yield d, np.flatnonzero(dims == d)


@dataclass(frozen=True)
class Moments:
    """``n`` fit weights, the mean of the vectors, their exact sum, and their covariance with divisor ``n``."""
    n: int
    total: list
    mean: np.ndarray
    covariance: np.ndarray


def moments(vectors: DataFrame, column: str) -> dict[int, Moments]:
    """Weighted moments of ``column`` for each value of ``dims``, read twice.

    ``vectors`` has ``dims`` and a whole ``weight`` a row; vectors of one ``dims`` have one length.  Sums of whole
    numbers are exact: they are added in halves, and put together as unbounded integers.
    """
    whole = vectors.schema[column].dataType.elementType.simpleString() == "bigint"
    vectors = vectors.select("dims", column, "weight")

    def sums():
        held: dict[int, list] = {}

        def step(batch):
            if batch is None:
                return {"dims": list(held), "n": [v[0] for v in held.values()], "total": [v[1] for v in held.values()]}
            for dims, at in _by_dims(batch):
                x, w = matrix_of(batch.column(column), at), batch.column("weight").to_numpy()[at]
                halves = np.concatenate([w @ (x >> 32), w @ (x & 0xFFFFFFFF)] if whole else [w @ x])
                now = held.setdefault(dims, [0, 0])
                now[0], now[1] = now[0] + int(w.sum()), now[1] + halves
            return None

        return step

    kind = "bigint" if whole else "double"
    parts = map_batches(vectors, sums, f"dims int, n bigint, total array<{kind}>", last=True)
    added = (parts.select("dims", "n", F.posexplode("total").alias("at", "value")).groupBy("dims", "at")
             .agg(F.sum("n").alias("n"), F.sum("value").alias("value")))
    held: dict[int, dict[int, tuple]] = {}
    for r in added.collect():  # as many rows as vectors have entries
        held.setdefault(r.dims, {})[r.at] = (r.n, r.value)
    first = {}
    for dims, found in held.items():
        n, values = found[0][0], [found[k][1] for k in range(len(found))]
        if whole:
            values = [(high << 32) + low for high, low in zip(values, values[len(values) // 2:])]
        first[dims] = Moments(n, values, np.array([v / n for v in values]), np.zeros((len(values), len(values))))
    sent = vectors.sparkSession.sparkContext.broadcast({d: m.mean for d, m in first.items()})

    def products():
        held: dict[int, np.ndarray] = {}

        def step(batch):
            if batch is None:
                rows = [(d, k, row) for d, m in held.items() for k, row in enumerate(m)]
                return {"dims": [r[0] for r in rows], "at": [r[1] for r in rows], "row": [r[2] for r in rows]}
            for dims, at in _by_dims(batch):
                x = matrix_of(batch.column(column), at) - sent.value[dims]
                w = batch.column("weight").to_numpy()[at].astype(np.float64)
                held[dims] = held.get(dims, 0) + (x * w[:, None]).T @ x
            return None

        return step

    parts = map_batches(vectors, products, "dims int, at int, row array<double>", last=True)
    for r in parts.groupBy("dims", "at").applyInArrow(_add_rows, "dims int, at int, row array<double>").collect():
        first[r.dims].covariance[r.at] = np.array(r.row) / first[r.dims].n
    return first


def _add_rows(table: pa.Table) -> pa.Table:
    """The sum of one matrix row over all tasks, in an order that does not depend on their arrival."""
    rows = matrix_of(table.column("row").combine_chunks(), np.arange(table.num_rows))
    rows = rows[np.lexsort(rows.T[::-1])].sum(axis=0)
    return pa.table({"dims": table.column("dims").slice(0, 1), "at": table.column("at").slice(0, 1),
                     "row": pa.array([rows], pa.list_(pa.float64()))})


@dataclass(frozen=True)
class Axes:
    """Unit eigenvectors (columns of ``vectors``) by falling eigenvalue, and their share of the whole variance."""
    fit: Moments
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray


def axes(fit: Moments, components: int) -> Axes:
    """The first components whose variance is more than rounding; of both signs the one with its largest entry above zero."""
    values, vectors = np.linalg.eigh((fit.covariance + fit.covariance.T) / 2)
    whole = float(np.trace(fit.covariance))
    order = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > LEAST_SHARE * whole]
    values, vectors = values[order], vectors[:, order]
    largest = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0)
    return Axes(fit, values, vectors * np.where(largest < 0, -1.0, 1.0), values / whole if whole else values)


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sum of (n x - total)^2 as exact integers; None where that is beyond a long."""
    apart = np.abs(x * float(n) - np.array(total, dtype=np.float64)).max(initial=0.0) * (1 + 1e-9) + 1
    if apart * apart * x.shape[1] < 2.0 ** 62 and max(map(abs, total)) < 1 << 62 and np.abs(x).max(initial=0) * float(n) < 2.0 ** 62:
        d = x * np.int64(n) - np.array(total, dtype=np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, total)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = 4, scale: float = 256.0, weights: str = "one", id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every fit row and component.

    ``weights`` is ``one`` (each distinct vector counts once) or ``count`` (as often as it occurs).  Rows whose vector is
    null or holds null or non-finite entries are left out; null and repeated ids are rows like any other.  Components
    are numbered from 1 by falling variance, at most ``components``; those without variance (fewer vectors than
    components, equal vectors, empty vectors) have no rows.  ``deviation`` is null where it exceeds a long.  Equal
    variances have any one set of axes.  Vectors of different lengths are whitened apart, with their own ``n`` and
    ``identity_error``.  Other columns are ignored and an empty table gives an empty result.
    """
    if weights not in ("one", "count"):
        raise ValueError(f"weights are one or count, not {weights}")
    spark = vectors.sparkSession
    rows = keyed(on_grid(spread(vectors.select(id_col, vector_col)), id_col, vector_col, scale))
    distinct = materialize(rows.groupBy("k1", "k2", "x").agg(F.count("*").alias("count")).select(
        "*", F.size("x").alias("dims"), (F.col("count") if weights == "count" else F.lit(1).cast("long")).alias("weight")),
        "whiten-distinct")
    models = {dims: axes(fit, components) for dims, fit in moments(distinct, "x").items()}
    sent = spark.sparkContext.broadcast(models)

    def project():
        def step(batch):
            deviation, white = [None] * batch.num_rows, [None] * batch.num_rows
            for dims, at in _by_dims(batch):
                model, x = sent.value[dims], matrix_of(batch.column("x"), at)
                put = (x - model.fit.mean) @ model.vectors / np.sqrt(model.values)
                for k, d, w in zip(at.tolist(), deviations(x, model.fit.n, model.fit.total), put):
                    deviation[k], white[k] = d, w
            return {n: batch.column(n) for n in ("k1", "k2", "count", "weight", "dims")} | {
                "deviation": deviation, "white": white}

        return step

    white = materialize(map_batches(distinct, project, "k1 bigint, k2 bigint, count bigint, weight bigint, dims int, "
                                                       "deviation bigint, white array<double>"), "whiten-white")
    forget(distinct)
    checked = moments(white.filter(F.size("white") > 0), "white")
    facts = [(dims, k, m.fit.n, float(m.explained[k]), float(np.abs(checked[dims].covariance - np.eye(len(m.values))).max()))
             for dims, m in models.items() for k in range(len(m.values))]
    told = spark.createDataFrame(facts, "dims int, k int, n bigint, explained double, identity_error double")

    all_rows = white.agg(F.sum("count")).first()[0] or 0
    marked = white.withColumn("shares", F.ceil(F.col("count") / max(1.0, all_rows / SHARES)).cast("int"))
    hot = marked.filter("shares > 1").select("k1", "k2", "shares")  # at most SHARES rows
    placed = (rows.select("id", "k1", "k2", F.monotonically_increasing_id().alias("place"))
              .join(F.broadcast(hot), ["k1", "k2"], "left")
              .select("id", "k1", "k2", F.pmod(F.xxhash64("place"), F.coalesce("shares", F.lit(1))).cast("int").alias("share")))
    copies = marked.select("k1", "k2", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"),
                           "dims", "deviation", "white")
    # a row per length of vectors and component is told to all
    return (placed.join(copies, ["k1", "k2", "share"])
            .select("id", "dims", "deviation", F.posexplode("white").alias("k", "whitened")).join(F.broadcast(told), ["dims", "k"])
            .select(F.col("id").alias(id_col), (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
                    "explained", "identity_error"))

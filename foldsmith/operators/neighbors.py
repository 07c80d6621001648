"""Nearest neighbours and dense scores of vectors, in bounded blocks.

Pairs of vectors are never emitted as rows.  A task gets one block of each side as two numpy matrices and returns a
few numbers per query.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import bind
from ..session import materialize
from .joins import join_dimension, join_group_stats
from .rank import distributed_rank, seeded_order

BLOCK = 2048
#: Bytes of vectors in a block that is sent to a task; it is read in tiles of ``BLOCK`` rows.
BLOCK_BYTES = 16 << 20
#: Bytes of pivots sent to every task; a base too large for the square root of its rows gets larger cells.
PIVOT_BYTES = 32 << 20
#: Queries whose visits are listed at once.
ROUTED_ROWS = 256


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(np.float64)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance row by row, from differences, so that equal vectors are exactly 0 apart."""
    out = np.empty(len(a))
    for at in range(0, len(a), 1 << 15):
        gap = a[at:at + (1 << 15)] - b[at:at + (1 << 15)]
        out[at:at + (1 << 15)] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and per row of ``a`` a bound on their rounding error."""
    shift = b.mean(axis=0)
    a, b = a - shift, b - shift
    na, nb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    squares = a @ b.T
    squares *= -2
    squares += na[:, None]
    squares += nb
    return squares, 4e-16 * (a.shape[1] + 8) * (na + nb.max())


def _between(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all distances."""
    squares, error = _squares(a, b)
    return np.sqrt(np.maximum(squares - error[:, None], 0)), np.sqrt(np.maximum(squares, 0) + error[:, None])


class _Tree:
    """Two levels of pivots, each about the square root of the level below.

    A vector lies in the leaf of the nearest pivot below its nearest top pivot.  Once the leaves' extents are known,
    the triangle inequality tells which leaves can hold anything within a distance of a query: first whole tops are
    ruled out, then leaves of the tops that remain.
    """

    def __init__(self, pivots: np.ndarray, block: int | None = None):
        self.block = block or BLOCK
        self.tops = pivots[:max(1, math.isqrt(len(pivots)))]
        owner = _between(pivots, self.tops)[1].argmin(axis=1)
        order = np.argsort(owner, kind="stable")
        self.leaves = pivots[order]
        self.first = np.searchsorted(owner[order], np.arange(len(self.tops) + 1))
        self.tops_used = np.flatnonzero(np.diff(self.first))
        self.count = np.zeros(len(pivots), dtype=np.int64)
        self.near, self.radius = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each vector and its distance from the leaf's pivot."""
        leaf = np.empty(len(x), dtype=np.int64)
        top = self.tops_used[_squares(x, self.tops[self.tops_used])[0].argmin(axis=1)]
        for t in np.unique(top):
            rows = np.flatnonzero(top == t)
            low, high = self.first[t], self.first[t + 1]
            leaf[rows] = low + _squares(x[rows], self.leaves[low:high])[0].argmin(axis=1)
        return leaf, _exact(x, self.leaves[leaf])

    def measure(self, leaf, count, near, radius) -> None:
        """Extents of the leaves that hold vectors, and from them those of the tops."""
        self.count[leaf], self.near[leaf], self.radius[leaf] = count, near, radius
        self.reach = np.full(len(self.tops), -np.inf)
        for t in self.tops_used:
            own = slice(self.first[t], self.first[t + 1])
            self.reach[t] = (_between(self.tops[t:t + 1], self.leaves[own])[1][0] + self.radius[own]).max()
        # a host is what a query is sent to: small leaves of one top together, or a leaf in as many blocks as it fills
        self.host = np.empty(len(self.leaves), dtype=np.int64)
        hosts = 0
        for t in self.tops_used:
            load = 0
            for c in range(self.first[t], self.first[t + 1]):
                if load and load + self.count[c] > self.block:
                    hosts, load = hosts + 1, 0
                self.host[c] = hosts
                load += self.count[c]
            hosts += 1
        self.blocks = np.maximum(-(-np.bincount(self.host, self.count, hosts).astype(np.int64) // self.block), 1)

    def bound(self, x: np.ndarray, need: int) -> np.ndarray:
        """The ``need``-th nearest pivot among the tops, which are base vectors: no more than that is to be searched."""
        if need > len(self.tops):
            return np.full(len(x), np.inf)
        return np.partition(_between(x, self.tops)[1], need - 1, axis=1)[:, need - 1]

    def open(self, x: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that can hold a vector within ``limit`` of the row."""
        limit = limit * (1 + 1e-9) + 1e-300
        rows, leaves = [], []
        least = _between(x, self.tops)[0]
        for t in self.tops_used:
            hit = np.flatnonzero(least[:, t] - self.reach[t] <= limit)
            if not len(hit):
                continue
            low, high = self.first[t], self.first[t + 1]
            under, over = _between(x[hit], self.leaves[low:high])
            gap = np.maximum(under - self.radius[low:high], self.near[low:high] - over)
            at, leaf = np.nonzero((gap <= limit[hit][:, None]) & (self.count[low:high] > 0))
            rows.append(hit[at])
            leaves.append(low + leaf)
        return np.concatenate(rows or [np.array([], dtype=int)]), np.concatenate(leaves or [np.array([], dtype=int)])


def _closest(left: pd.DataFrame, right: pd.DataFrame, need: int, limit: np.ndarray) -> pd.DataFrame:
    """(at, nid, distance): for every row of ``left`` its ``need`` nearest by (distance, id), none beyond ``limit``.

    A row of ``right`` is a vector and the lowest ids that have it.  Both sides meet in tiles of ``BLOCK`` rows, of which
    each keeps its ``need`` best so far and so narrows the limit of the next.  Candidates come from a matrix product with
    an error bound; only they are measured by differences.
    """
    a, b = _matrix(left["vec"]), _matrix(right["vec"])
    ids = right["ids"].to_numpy()
    sizes = np.array([len(i) for i in ids])
    out = []
    for low in range(0, len(a), BLOCK):
        rows, reach, best = a[low:low + BLOCK], limit[low:low + BLOCK].copy(), None
        for first in range(0, len(b), BLOCK):
            found = _tile(rows, b[first:first + BLOCK], ids[first:first + BLOCK], sizes[first:first + BLOCK], need, reach)
            if found is None:
                continue
            best = found if best is None else pd.concat([best, found])
            best = best.sort_values(["at", "distance", "nid"], kind="stable")
            place = best.groupby("at").cumcount()
            best = best[place < need]
            last = best[place[place < need].to_numpy() == need - 1]
            at = last["at"].to_numpy()
            reach[at] = np.minimum(reach[at], last["distance"].to_numpy())
        if best is not None:
            out.append(best.assign(at=best["at"] + low))
    if not out:
        return pd.DataFrame({"at": np.array([], dtype=np.int64), "distance": np.array([], dtype=float), "nid": right["ids"].explode()[:0]})
    return pd.concat(out, ignore_index=True)


def _tile(a: np.ndarray, b: np.ndarray, ids: np.ndarray, sizes: np.ndarray, need: int, limit: np.ndarray) -> pd.DataFrame | None:
    """(at, distance, nid) of the pairs of one tile that can be among the ``need`` nearest within ``limit``."""
    squares, error = _squares(a, b)
    top = np.square(limit * (1 + 1e-9)) + error
    wide = np.flatnonzero((squares <= top[:, None]).sum(axis=1) > need)
    if len(wide):  # the tile's own k-th is a closer bound
        k = min(need, len(b)) - 1
        top[wide] = np.minimum(top[wide], np.partition(squares[wide], k, axis=1)[:, k] + 2 * error[wide])
    at, other = np.nonzero(squares <= top[:, None])
    if not len(at):
        return None
    many = sizes[other]
    found = pd.DataFrame({"at": np.repeat(at, many), "distance": np.repeat(_exact(a[at], b[other]), many)})
    found["nid"] = np.concatenate([ids[j] for j in other])
    return found[np.isfinite(found["distance"])]


def _distinct_vectors(rows: DataFrame, row_id: str, vector: str) -> DataFrame:
    """(id, vec) of the rows whose vector is whole and finite."""
    cells = F.col(vector).cast("array<double>")
    fit = F.forall(cells, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.select(F.col(row_id).alias("id"), cells.alias("vec")).filter(F.col("vec").isNotNull() & fit)


def knn_join(queries: DataFrame, base: DataFrame, k: int, query_id: str = "id", base_id: str = "id", vector: str = "vec",
             skip_self: bool = False) -> DataFrame:
    """Exact ``k`` nearest base vectors of each query: (query_id, neighbor_id, distance, rank), ties by id.

    Equal vectors are searched once and stand for their lowest ids.  The base lies in a two-level tree of pivots, as many
    as the square root of its vectors, its leaves cut in blocks of ``BLOCK_BYTES``, which a task reads in tiles of ``BLOCK``.  Phase one measures each query against
    one block of its own leaf, which bounds its k-th distance; phase two visits the other blocks that this bound and the
    triangle inequality leave open.  Blocks meet as numpy matrices and return at most ``k`` rows a query; a block is
    copied once per as many visitors as it has rows at most.  Vectors that are missing or not finite have no neighbours and are none's.
    """
    spark = base.sparkSession
    need = k + (1 if skip_self else 0)
    kind, qkind = base.schema[base_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    members, asked = _distinct_vectors(base, base_id, vector), _distinct_vectors(queries, query_id, vector)
    lowest = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    # the limit on the row number cuts the copies of a vector before they are shuffled
    stored = materialize(members.withColumn("_r", lowest).filter(F.col("_r") <= need).groupBy("vec").agg(
        F.sort_array(F.collect_list("id")).alias("ids")), "knn-base")
    shape = stored.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    if not shape["n"]:
        raise ValueError("the base has no vectors")
    pivots = max(1, min(math.isqrt(shape["n"]), PIVOT_BYTES // (8 * max(shape["dim"], 1))))
    chosen = stored.orderBy(seeded_order("pivot", F.col("ids")[0])).select("vec").limit(pivots).collect()
    block = max(BLOCK, BLOCK_BYTES // (8 * max(shape["dim"], 1)))
    tree = _Tree(np.array([r["vec"] for r in chosen], dtype=np.float64), block)
    planted = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                leaf, far = planted.value.place(_matrix(pdf["vec"]))
                yield pdf.assign(cell=leaf, far=far)

    placed = materialize(stored.withColumn("h", F.xxhash64(F.col("ids")[0])).mapInPandas(
        place, f"vec array<double>, ids array<{kind}>, h long, cell long, far double"), "knn-cells")
    alike = asked.groupBy("vec").agg(F.min("id").alias("qid"), F.count("*").alias("n")).withColumn("h", F.xxhash64("qid"))
    seekers = materialize(alike.mapInPandas(
        place, f"vec array<double>, qid {qkind}, n long, h long, cell long, far double"), "knn-queries")
    # one row a leaf: the pivots' number bounds both
    extents = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("near"), F.max("far").alias("far")).collect()
    tree.measure(*(np.array([r[c] for r in extents]) for c in ("cell", "n", "near", "far")))
    crowd = np.zeros(len(tree.blocks), dtype=np.int64)
    for r in seekers.groupBy("cell").count().collect():
        crowd[tree.host[r["cell"]]] += r["count"]
    shares = np.maximum(-(-crowd // (block * tree.blocks)), 1)
    measured = spark.sparkContext.broadcast((tree, shares))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grown, parts = measured.value
        for pdf in batches:
            host, h = grown.host[pdf["cell"].to_numpy()], pdf["h"].to_numpy()
            yield pdf.assign(cell=host, bb=h % grown.blocks[host], qb=h // grown.blocks[host] % parts[host])

    def repeat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grown, parts = measured.value
        for pdf in batches:
            host = grown.host[pdf["cell"].to_numpy()]
            rows = pdf.assign(cell=host, bb=pdf["h"].to_numpy() % grown.blocks[host])
            each = parts[host]
            out = rows.iloc[np.repeat(np.arange(len(rows)), each)]
            yield out.assign(qb=np.arange(len(out)) - np.repeat(np.cumsum(each) - each, each))

    keys = ["cell", "bb", "qb"]
    first_base = placed.drop("far").mapInPandas(repeat, f"vec array<double>, ids array<{kind}>, h long, cell long, bb long, qb long")
    dealt = seekers.select("qid", "vec", "h", "cell").mapInPandas(
        deal, f"qid {qkind}, vec array<double>, h long, cell long, bb long, qb long")

    def own_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.reset_index(drop=True)
        if left.empty:
            return left[["qid", "vec", "h", "cell", "bb"]].assign(limit=np.array([], dtype=float), found=pd.Series([], dtype=object))
        limit = measured.value[0].bound(_matrix(left["vec"]), need)
        found = [[] for _ in range(len(left))]
        if len(right):
            best = _closest(left, right, need, limit)
            for at, far, nid in zip(best["at"].tolist(), best["distance"].tolist(), best["nid"].tolist()):
                found[at].append({"distance": far, "nid": nid})  # nearest first
                if len(found[at]) == need:
                    limit[at] = min(limit[at], far)
        return left[["qid", "vec", "h", "cell", "bb"]].assign(limit=limit, found=found)

    pair = f"struct<distance: double, nid: {kind}>"
    bounded = materialize(dealt.groupBy(*keys).cogroup(first_base.groupBy(*keys)).applyInPandas(
        own_block, f"qid {qkind}, vec array<double>, h long, cell long, bb long, limit double, found array<{pair}>"), "knn-bounds")

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grown = measured.value[0]
        for pdf in batches:
            for low in range(0, len(pdf), ROUTED_ROWS):  # a row can go to every block
                part = pdf.iloc[low:low + ROUTED_ROWS]
                row, leaf = grown.open(_matrix(part["vec"]), part["limit"].to_numpy())
                row, host = np.divmod(np.unique(row * len(grown.blocks) + grown.host[leaf]), len(grown.blocks))
                each = grown.blocks[host]
                row, host = np.repeat(row, each), np.repeat(host, each)
                block = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                seen = (host == part["cell"].to_numpy()[row]) & (block == part["bb"].to_numpy()[row])
                yield part[["qid", "vec", "h", "limit"]].iloc[row[~seen]].assign(cell=host[~seen], bb=block[~seen])

    routed = materialize(bounded.select("qid", "vec", "h", "limit", "cell", "bb").mapInPandas(
        visit, f"qid {qkind}, vec array<double>, h long, limit double, cell long, bb long"), "knn-visits")
    guests = materialize(routed.groupBy("cell", "bb").agg(F.count("*").alias("n"))
                         .withColumn("parts", F.ceil(F.col("n") / block)), "knn-guests")
    blocked = placed.drop("far").mapInPandas(deal, f"vec array<double>, ids array<{kind}>, h long, cell long, bb long, qb long").drop("qb")
    hosts = (blocked.join(guests.drop("n"), ["cell", "bb"])
             .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts", "h"))
    going = join_group_stats(routed, guests, ["cell", "bb"], ["qid"]).withColumn("qb", F.pmod("h", "parts")).drop("n", "parts", "h")

    def other_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"qid": left["qid"][:0], "distance": np.array([], dtype=float), "nid": right["ids"].explode()[:0]})
        best = _closest(left, right, need, left["limit"].to_numpy())
        return pd.DataFrame({"qid": left["qid"].to_numpy()[best["at"]], "distance": best["distance"].to_numpy(), "nid": best["nid"].to_numpy()})

    further = going.groupBy(*keys).cogroup(hosts.groupBy(*keys)).applyInPandas(other_block, f"qid {qkind}, distance double, nid {kind}")
    every = bounded.select("qid", F.inline("found")).unionByName(further)
    best = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "nid"))
    answers = (every.withColumn("_r", best).filter(F.col("_r") <= need).groupBy("qid")
               .agg(F.sort_array(F.collect_list(F.struct("distance", "nid"))).alias("found")))
    answers = materialize(seekers.select("qid", "vec", "n").join(answers, "qid").drop("qid"), "knn-answers")
    told = join_group_stats(asked, answers, ["vec"], ["id"])
    others = F.filter("found", lambda f: f["nid"] != F.col("id")) if skip_self else F.col("found")
    return (told.select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("_p", "_f"))
            .select("query_id", F.col("_f.nid").alias("neighbor_id"), F.col("_f.distance").alias("distance"),
                    (F.col("_p") + 1).alias("rank")))


def assign_nearest(orphans: DataFrame, members: DataFrame, cluster: str, row_id: str = "id", vector: str = "vec") -> DataFrame:
    """Each orphan vector joins the cluster of its nearest member, the lowest id at equal distance."""
    nearest = materialize(knn_join(orphans, members, 1, row_id, row_id, vector), "nearest")
    owner = members.select(F.col(row_id).alias("neighbor_id"), F.col(cluster))
    return join_dimension(nearest, owner, ["neighbor_id"], ["query_id"]).select(F.col("query_id").alias(row_id), cluster, "distance")


def score_pairs(links: DataFrame, items: DataFrame, groups: DataFrame, item: str, group: str, vector: str = "vec",
                group_vector: str = "group_vec", unit: bool = True) -> DataFrame:
    """Dot product of the (normalized) vectors of given pairs: two equi-joins, all in the JVM, busy sides spread."""
    shape = V.normalize if unit else (lambda c: c)
    left = items.select(item, shape(F.col(vector)).alias("_u"))
    right = groups.select(group, shape(F.col(group_vector)).alias("_v"))
    placed = join_dimension(join_dimension(links, left, [item], [group]), right, [group], [item])
    return placed.withColumn("score", V.dot(F.col("_u"), F.col("_v"))).drop("_u", "_v")


def _block_scores(items: DataFrame, groups: DataFrame, item: str, group: str, vector: str, group_vector: str,
                  carry: list[str], fn: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """``fn(item block, group block, scores)`` for every block of items against every block of groups."""
    item_blocks = max(1, math.ceil(items.count() / BLOCK))
    group_blocks = max(1, math.ceil(groups.count() / BLOCK))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = items.select(F.col(item).alias("id"), V.normalize(F.col(vector)).alias("u"), *carry,
                        F.pmod(F.xxhash64(item), F.lit(item_blocks)).cast("int").alias("ib"), every(group_blocks).alias("gb"))
    right = groups.select(F.col(group).alias("gid"), V.normalize(F.col(group_vector)).alias("v"),
                          F.pmod(F.xxhash64(group), F.lit(group_blocks)).cast("int").alias("gb"), every(item_blocks).alias("ib"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        scores = _matrix(a["u"]) @ _matrix(b["v"]).T if len(a) and len(b) else np.zeros((len(a), len(b)))
        return fn(a, b, scores)

    return left.groupBy("ib", "gb").cogroup(right.groupBy("ib", "gb")).applyInPandas(run, schema)


def dense_scores(items: DataFrame, groups: DataFrame, item: str, group: str, vector: str = "vec",
                 group_vector: str = "group_vec") -> DataFrame:
    """Score of every item against every group, the matrix itself being the result: (item, group, score)."""
    def unroll(a, b, scores):
        return pd.DataFrame({"id": np.repeat(a["id"].to_numpy(), len(b)), "gid": np.tile(b["gid"].to_numpy(), len(a)),
                             "score": scores.ravel()})

    kinds = items.schema[item].dataType.simpleString(), groups.schema[group].dataType.simpleString()
    out = _block_scores(items, groups, item, group, vector, group_vector, [], unroll,
                        f"id {kinds[0]}, gid {kinds[1]}, score double")
    return out.select(F.col("id").alias(item), F.col("gid").alias(group), "score")


def best_groups(items: DataFrame, groups: DataFrame, k: int, item: str, group: str, vector: str = "vec",
                group_vector: str = "group_vec", unit: bool = True) -> DataFrame:
    """The ``k`` groups of highest score per item, without the matrix of all scores: (item, group, score, rank), ties by group.

    Scores are dot products, of the normalized vectors unless ``unit`` is off.  A further coordinate brings all groups to
    the length of the longest, which is one number for the driver, and is zero in the items: then the nearest group is the
    one of highest score, and the search of :func:`knn_join` prunes whole blocks of groups.  The scores of the ``k`` pairs
    are then taken from the given vectors; scores closer than 1e-15 of the longest length squared count as tied.  Items and
    groups whose vectors are missing or not finite are left out; without groups there are no rows.
    """
    shape = V.normalize if unit else (lambda v: F.transform(v, lambda x: x.cast("double")))
    sized = groups.select(F.col(group).alias("gid"), shape(F.col(group_vector)).alias("v"))
    sized = sized.withColumn("length", V.dot(F.col("v"), F.col("v"))).filter(F.col("length") < float("inf"))
    sized = materialize(sized, "group-lengths")
    longest = sized.agg(F.max("length")).first()[0]
    kinds = items.schema[item].dataType.simpleString(), groups.schema[group].dataType.simpleString()
    if longest is None:
        return items.sparkSession.createDataFrame([], f"`{item}` {kinds[0]}, `{group}` {kinds[1]}, score double, rank int")
    rest = F.sqrt(F.greatest(F.lit(longest) - F.col("length"), F.lit(0.0)))
    base = sized.select("gid", F.concat("v", F.array(rest)).alias("vec"))
    asked = items.select(F.col(item).alias("id"), F.concat(shape(F.col(vector)), F.array(F.lit(0.0))).alias("vec"))
    found = knn_join(asked, base, k, "id", "gid").select(F.col("query_id").alias(item), F.col("neighbor_id").alias(group), "rank")
    scored = score_pairs(materialize(found, "best-groups"), items, groups, item, group, vector, group_vector, unit)
    return scored.select(item, group, "score", F.col("rank").cast("int").alias("rank"))


def truth_ranks(items: DataFrame, groups: DataFrame, item: str, truth: str, group: str, vector: str = "vec",
                group_vector: str = "group_vec", ties_count: bool = True) -> DataFrame:
    """1-based rank of the right group among all groups of each item: 1 + better ones (+ equals, unless told not to).

    Each block returns two counts per item, so no score leaves its task.
    """
    kind, gkind = items.schema[item].dataType.simpleString(), groups.schema[group].dataType.simpleString()
    truths = groups.select(F.col(group).alias(truth), V.normalize(F.col(group_vector)).alias("_t"))
    known = join_dimension(items, truths, [truth], [item]).select(
        item, vector, F.col(truth).alias("truth"), V.dot(V.normalize(F.col(vector)), F.col("_t")).alias("target"))
    known = materialize(known, "truth-scores")

    def count(a, b, scores):
        other = a["truth"].to_numpy()[:, None] != b["gid"].to_numpy()[None, :]
        gap = scores - a["target"].to_numpy()[:, None]
        same = np.abs(gap) <= 1e-9
        return pd.DataFrame({"id": a["id"], "above": (other & (gap > 0) & ~same).sum(axis=1),
                             "equal": (other & same).sum(axis=1)})

    counts = _block_scores(known, groups, item, group, vector, group_vector, ["truth", "target"], count,
                           f"id {kind}, above long, equal long")
    summed = counts.groupBy("id").agg(F.sum("above").alias("above"), F.sum("equal").alias("equal"))
    rank = 1 + F.col("above") + (F.col("equal") if ties_count else F.lit(0))
    return summed.select(F.col("id").alias(item), rank.alias("rank"))


def knn_votes(train: DataFrame, test: DataFrame, k: int, row_id: str, label: str, vector: str = "vec") -> DataFrame:
    """(row_id, rank, label) of the ``k`` nearest training rows of each test row; a smaller ``k`` is read off by rank."""
    found = materialize(knn_join(test, train, k, row_id, row_id, vector).select("query_id", "neighbor_id", "rank"), "knn-votes")
    voted = join_dimension(found, train.select(F.col(row_id).alias("neighbor_id"), label), ["neighbor_id"], ["query_id"])
    return voted.select(F.col("query_id").alias(row_id), "rank", label)


def knn_shares(votes: DataFrame, k: int, row_id: str, label: str) -> DataFrame:
    """(row_id, probability, prediction): share of positives among the ``k`` first of :func:`knn_votes`."""
    share = votes.filter(F.col("rank") <= k).groupBy(row_id).agg(F.avg(label).alias("probability"))
    return share.withColumn("prediction", (F.col("probability") > 0.5).cast("double"))


def knn_classify(train: DataFrame, test: DataFrame, k: int, row_id: str, label: str, vector: str = "vec") -> DataFrame:
    """(row_id, probability, prediction): share of positives among the ``k`` nearest training rows."""
    return knn_shares(knn_votes(train, test, k, row_id, label, vector), k, row_id, label)


def smote(rows: DataFrame, row_id: str, vector: str, label: str, k: int = 6, seed: int = 42) -> DataFrame:
    """Synthetic minority vectors up to the majority's size: (parent_id, neighbor_id, copy, vector).

    Copy ``j`` starts from minority row ``j`` modulo their number, walks towards one of its ``k`` nearest minority
    rows and stops at a seeded share of the way, so the result does not depend on partitioning.
    """
    sizes = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    minority, majority = sorted(sizes, key=lambda c: (sizes[c], c))
    few, need = sizes[minority], sizes[majority] - sizes[minority]
    own = rows.filter(F.col(label) == minority).select(F.col(row_id).alias("id"), F.col(vector).alias("vec"))
    k = min(k, few - 1)
    if k < 1:
        raise ValueError("a single minority row has no neighbour to walk to")
    links = materialize(knn_join(own, own, k, skip_self=True), "smote-links")
    ranked = materialize(distributed_rank(own, [], seeded_order(seed, "id"), [F.col("id")], out="r"), "smote-rows")
    parents = ranked.select("r", F.col("id").alias("parent_id"), F.col("vec").alias("parent_vec"),
                            F.lit(math.ceil(need / few)).cast("long").alias("n"))
    copies = rows.sparkSession.range(need).select(F.col("id").alias("copy"), (F.col("id") % few).alias("r"))
    made = join_group_stats(copies, parents, ["r"], ["copy"]).drop("n", "r")
    pick = 1 + F.pmod(F.conv(F.substring(seeded_order(f"{seed}/pick", "parent_id", "copy"), 1, 8), 16, 10).cast("long"), F.lit(k))
    share = F.conv(F.substring(seeded_order(f"{seed}/gap", "parent_id", "copy"), 1, 8), 16, 10).cast("double") / float(2 ** 32)
    walked = made.withColumns({"rank": pick.cast("int"), "gap": share})
    ends = links.select(F.col("query_id").alias("parent_id"), "neighbor_id", "rank").join(
        own.select(F.col("id").alias("neighbor_id"), F.col("vec").alias("end_vec")), "neighbor_id")
    ends = materialize(ends.withColumn("n", F.lit(math.ceil(need / few)).cast("long")), "smote-ends")
    joined = join_group_stats(walked, ends, ["parent_id", "rank"], ["copy"]).drop("n")
    step = F.struct("gap", F.col("parent_vec").cast("array<double>").alias("p"), F.col("end_vec").cast("array<double>").alias("e"))
    cells = bind(step, lambda s: F.zip_with(s["p"], s["e"], lambda x, y: x + s["gap"] * (y - x)))
    return joined.select("parent_id", "neighbor_id", "copy", cells.alias(vector), F.lit(minority).alias(label))


def tomek_links(rows: DataFrame, row_id: str, vector: str, label: str) -> DataFrame:
    """Pairs (a, b), a < b, of opposite label that are each other's nearest neighbour."""
    named = rows.select(F.col(row_id).alias("id"), F.col(vector).alias("vec"))
    first = materialize(knn_join(named, named, 1, skip_self=True), "tomek").select(
        F.col("query_id").alias("a"), F.col("neighbor_id").alias("b"))
    mutual = first.join(first.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).filter("a < b")
    classes = rows.select(row_id, label)
    both = (mutual.join(classes.withColumnsRenamed({row_id: "a", label: "a_label"}), "a")
            .join(classes.withColumnsRenamed({row_id: "b", label: "b_label"}), "b"))
    return both.filter("a_label <> b_label").select("a", "b", "a_label", "b_label")


def without_links(rows: DataFrame, links: DataFrame, row_id: str) -> DataFrame:
    """Rows that are on neither side of a link."""
    ids = links.select(F.col("a").alias(row_id)).unionByName(links.select(F.col("b").alias(row_id))).distinct()
    return rows.join(ids, row_id, "left_anti")

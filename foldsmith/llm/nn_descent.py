"""Embedding near-duplicates by NN-descent.

The neighbour graph starts from a few random orders (sign codes of hyperplanes): each order is cut into small windows
of consecutive vectors that are compared as matrices.  A window gives a spanning forest of its links, so no two parts
of it that a link connects stay apart, and every vector keeps its ``k`` best and its ``k`` best of other components.
Then neighbours of neighbours are joined, round after round, until they bring no new link.  A join skips pairs that
links connect already: lists of vectors in a dense group are saturated, whatever ``k``, so instead of growing ``k`` step
by step a saturated list is enlarged at once to its whole component, block against block, where links are counted and
never written out, and its ``k`` entries of other components lead out of the group.

Recall is audited against brute force for a bounded number of vectors over all others, each vector counting the same;
those with few links, with many, and those of small labels are judged apart, and the least recall decides.  More orders
are added until it is reached, and a recall still missed after the last order is an error.  Equal vectors of a label are
folded into one node beforehand.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import join_group_stats
from ..session import materialize, spread
from .common import map_batches
from .components import components

NEIGHBOURS = 8
ORDERS = 6
WINDOW = 256
BLOCK = 400
MOST_BITS = 40  # of a sign code
EXPLORE = 0.9  # neighbours at least this near are kept in the lists: a link's ends share them
AUDITED = 256  # vectors of a kind
RECALL = 0.98
MOST_ORDERS = 48


def fold(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, node, label, vec): node is null for vectors that link with nothing; else a digest of label and vector."""
    rows = spread(vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"),
                                 F.col(vector_col).cast("array<double>").alias("vec")))
    kind = rows.schema["id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch):
            nodes, data = [], []
            for label, values in zip(batch.column("label").to_pylist(), batch.column("vec")):
                v = None
                if label is not None and values.is_valid and len(values) and not values.values.null_count:
                    v = values.values.to_numpy(zero_copy_only=False) + 0.0
                    if not np.isfinite(v).all() or not v.any():
                        v = None
                data.append(None if v is None else v.tobytes())
                nodes.append(None if v is None else hashlib.blake2b(
                    data[-1], digest_size=16, key=hashlib.blake2b(label.encode()).digest()).digest())
            return {"id": batch.column("id"), "node": nodes, "label": batch.column("label"), "vec": data}
        return step

    return materialize(map_batches(rows, make, f"id {kind}, node binary, label string, vec binary"), "nn-rows")


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column of equally long float64 bytes, scaled to length 1."""
    m = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T


def forest(linked: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The component of every row of a symmetric matrix of links, and links that span each component."""
    part, spanning = np.full(len(linked), -1), []
    for root in range(len(linked)):
        if part[root] >= 0:
            continue
        part[root], todo = root, [root]
        for i in todo:  # grows while it is read
            reached = np.flatnonzero(linked[i] & (part < 0)).tolist()
            part[reached] = root
            todo += reached
            spanning += [(i, j) for j in reached]
    return part, spanning


def nearest(sims: np.ndarray, threshold: float, k: int) -> set[tuple[int, int]]:
    """Pairs of at least ``EXPLORE``: each row's ``k`` best, its ``k`` best of other components and a spanning forest."""
    part, spanning = forest(sims >= threshold)
    rows = np.flatnonzero(sims.max(axis=1) >= EXPLORE)
    ranked = np.argsort(-sims[rows], axis=1, kind="stable")
    near = np.take_along_axis(sims[rows], ranked, axis=1) >= EXPLORE
    foreign = near & (part[ranked] != part[rows][:, None])
    kept = near & (np.arange(len(sims)) < k) | foreign & (foreign.cumsum(axis=1) <= k)
    i, place = np.nonzero(kept)
    pairs = set(zip(rows[i].tolist(), ranked[i, place].tolist()))
    return pairs.union(spanning, ((j, i) for i, j in spanning))


def with_bits(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """``nodes`` with the number of code bits that leave half a window's vectors of one label and length to a code."""
    size = F.octet_length("vec").alias("size")
    sizes = rows.select("label", size, "node").groupBy("label", "size").agg(F.countDistinct("node").alias("n"))
    bits = F.least(F.lit(MOST_BITS), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / F.lit(WINDOW // 2)))))
    sizes = materialize(sizes.withColumn("bits", bits.cast("int")), "nn-groups")
    return join_group_stats(nodes.select("*", size), sizes, ["label", "size"], ["node"]).drop("size", "n")


def window_links(nodes: DataFrame, order: int, k: int, threshold: float) -> DataFrame:
    """(a, b, sim): what :func:`nearest` gives among the vectors near each other in one random order."""
    def coded():
        planes: dict[int, np.ndarray] = {}

        def step(batch: pa.RecordBatch):
            m = np.array(batch.column("vec").to_pylist(), dtype=object)
            sizes = np.array([len(x) // 8 for x in m])
            bits = batch.column("bits").to_numpy().astype(np.int64)
            code, along = np.zeros(len(m), np.int64), np.zeros(len(m))
            for d in np.unique(sizes):
                if d not in planes:
                    planes[d] = np.random.default_rng([order, int(d)]).normal(size=(d, MOST_BITS + 1))
                at = np.flatnonzero(sizes == d)
                sides = matrix(batch.column("vec").take(pa.array(at))) @ planes[d]
                whole = ((sides[:, 1:] > 0) << np.arange(MOST_BITS, dtype=np.int64)).sum(axis=1)
                code[at] = whole & ((1 << bits[at]) - 1)
                along[at] = sides[:, 0]
            return {"node": batch.column("node"), "label": batch.column("label"), "vec": batch.column("vec"),
                    "size": sizes, "code": code, "along": along}
        return step

    placed = map_batches(nodes.select("node", "label", "vec", "bits"), coded,
                         "node binary, label string, vec binary, size bigint, code bigint, along double")
    ordered = placed.repartitionByRange("label", "size", "code", "along", "node").sortWithinPartitions(
        "label", "size", "code", "along", "node")

    def make():
        held: list[pa.RecordBatch] = []

        def step(batch: pa.RecordBatch | None):
            if batch is not None:
                held.append(batch)
            rows = pa.Table.from_batches(held).combine_chunks() if held else None
            out = {"a": [], "b": [], "sim": []}
            if rows is None or (batch is not None and rows.num_rows < 2 * WINDOW):
                return None
            groups = np.array([f"{s}:{x}" for s, x in zip(rows["size"].to_pylist(), rows["label"].to_pylist())])
            names = np.array(rows["node"].to_pylist(), dtype=object)
            last = rows.num_rows
            for start in range(0, max(1, last - WINDOW // 2), WINDOW // 2):
                end = min(last, start + WINDOW)
                for group in np.unique(groups[start:end]):
                    at = start + np.flatnonzero(groups[start:end] == group)
                    m = matrix(rows["vec"].combine_chunks().take(pa.array(at)))
                    sims = cosines(m, m)
                    np.fill_diagonal(sims, -1)
                    for i, j in nearest(sims, threshold, k):
                        out["a"].append(names[at[i]])
                        out["b"].append(names[at[j]])
                        out["sim"].append(float(sims[i, j]))
            held[:] = [] if batch is None else rows.slice(last - WINDOW // 2).to_batches()
            return out

        return step

    return map_batches(ordered, make, "a binary, b binary, sim double", last=True)


def best(links: DataFrame, part: DataFrame, k: int) -> DataFrame:
    """(a, b, sim, foreign): the neighbour lists, at most ``k`` of each vector's component and ``k`` of others."""
    ends = links.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    for end in ("a", "b"):
        ends = (ends.join(part.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
                .withColumn(f"of_{end}", F.coalesce(f"of_{end}", end)))
    ends = ends.select("a", "b", "sim", (F.col("of_a") != F.col("of_b")).alias("foreign"))
    rank = Window.partitionBy("a", "foreign").orderBy(F.col("sim").desc(), "b")
    return ends.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= k).drop("r")


def join_neighbours(lists: DataFrame, nodes: DataFrame, part: DataFrame, k: int, turn: int) -> DataFrame:
    """(a, b, sim) of neighbours of neighbours that no links connect yet, where at least ``EXPLORE``."""
    back = lists.select(F.col("b").alias("host"), F.col("a").alias("member"), "foreign")
    # a hub is met through k vectors of its component and k of others, which differ from round to round
    some = Window.partitionBy("host", "foreign").orderBy(F.xxhash64("member", F.lit(turn)), "member")
    back = back.withColumn("r", F.row_number().over(some)).filter(F.col("r") <= k).select("host", "member")
    around = (lists.select(F.col("a").alias("host"), F.col("b").alias("member")).unionByName(back)
              .unionByName(lists.select(F.col("a").alias("host"), F.col("a").alias("member"))).distinct()
              .join(part.select(F.col("node").alias("member"), "component"), "member", "left")
              .withColumn("component", F.coalesce("component", "member")))
    # a host whose surroundings are one component has nothing to join
    mixed = around.groupBy("host").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    around = materialize(around.join(mixed.select("host"), "host"), "nn-around")
    l, r = around.alias("l"), around.alias("r")
    pairs = (l.join(r, (F.col("l.host") == F.col("r.host")) & (F.col("l.member") < F.col("r.member"))
                    & (F.col("l.component") != F.col("r.component")))
             .select(F.col("l.member").alias("a"), F.col("r.member").alias("b")).distinct()
             .join(lists.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    ends = (pairs.join(nodes.select(F.col("node").alias("a"), F.col("vec").alias("va")), "a")
            .join(nodes.select(F.col("node").alias("b"), F.col("vec").alias("vb")), "b").select("a", "b", "va", "vb")
            .filter(F.octet_length("va") == F.octet_length("vb")))

    def make():
        def step(batch: pa.RecordBatch):
            size = np.array([len(x.as_buffer()) for x in batch.column("va")])
            out = {"a": [], "b": [], "sim": []}
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for d in np.unique(size):
                at = pa.array(np.flatnonzero(size == d))
                sims = (matrix(batch.column("va").take(at)) * matrix(batch.column("vb").take(at))).sum(axis=1)
                for i, s in zip(at.to_pylist(), sims):
                    if s >= EXPLORE:
                        out["a"] += [a[i], b[i]]
                        out["b"] += [b[i], a[i]]
                        out["sim"] += [float(s)] * 2
            return out
        return step

    return map_batches(ends, make, "a binary, b binary, sim double")


def count_links(nodes: DataFrame, part: DataFrame, threshold: float) -> DataFrame:
    """(node, linked): the rows behind all nodes of the component that link with it, block against block."""
    sizes = part.groupBy("component").agg(F.count("*").alias("n")).withColumn(
        "blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = materialize(part.join(materialize(sizes, "nn-sizes"), "component").join(nodes, "node")
                          .select("component", "blocks", "node", "copies", "vec")
                          .withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "nn-members")
    met = (members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select("component", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine",
                   "node", "copies", "vec"))
    keys = ["component", "lo", "hi"]
    dealt = met.repartition(*keys).sortWithinPartitions(*keys, "node")

    def make():
        held: list[pa.RecordBatch] = []

        def count(rows: pa.Table) -> tuple[list[bytes], np.ndarray]:
            rows = rows.combine_chunks()
            m, copies = matrix(rows["vec"].combine_chunks()), rows["copies"].to_numpy()
            linked = cosines(m, m) >= threshold
            np.fill_diagonal(linked, False)
            mine = rows["mine"].to_numpy()
            if rows["lo"][0].as_py() != rows["hi"][0].as_py():  # a block with itself is counted where lo = hi
                linked &= mine[:, None] != mine[None, :]
            return rows["node"].to_pylist(), linked @ copies

        def step(batch: pa.RecordBatch | None):
            if batch is not None:
                held.append(batch)
            if not held:
                return None
            rows = pa.Table.from_batches(held)
            key = [(c, x, y) for c, x, y in zip(*(rows[k].to_pylist() for k in keys))]
            cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            if batch is not None:  # the last group may go on
                held[:] = rows.slice(cuts[-2]).to_batches()
                cuts.pop()
            out: dict[str, list] = {"node": [], "linked": []}
            for a, b in zip(cuts, cuts[1:]):
                names, counts = count(rows.slice(a, b - a))
                out["node"] += names
                out["linked"] += counts.tolist()
            return out

        return step

    counted = map_batches(dealt, make, "node binary, linked bigint", last=True)
    return materialize(counted.groupBy("node").agg(F.sum("linked").alias("linked")), "nn-counts")


def audit(nodes: DataFrame, counts: DataFrame, threshold: float, most: int, k: int) -> float:
    """The least of the shares of a vector's links that were found, on average over the vectors of a kind.

    Kinds are vectors with up to ``k`` links and with more, of small and of other labels.  Brute force is asked for at
    most ``most`` vectors, the first by a hash, of every kind of what was found (no link being one), and each stands for
    its share of them.
    """
    linked = F.coalesce("linked", F.lit(0))
    kind = (F.col("bits") > 0).cast("int") * 3 + (linked > 0).cast("int") + (linked > k).cast("int")
    graded = materialize(nodes.select("node", "bits").join(counts, "node", "left")
                         .select("node", "bits", linked.alias("linked"), kind.alias("kind")), "nn-graded")
    there = {r["kind"]: r["count"] for r in graded.groupBy("kind").count().collect()}
    asked = None
    for one in there:
        part = graded.filter(F.col("kind") == one).orderBy(F.xxhash64("node"), "node").limit(most)
        asked = part if asked is None else asked.unionByName(part)
    if asked is None:
        return 1.0
    rows = nodes.drop("bits").join(F.broadcast(asked), "node").select(
        "node", "label", "vec", "bits", "linked", "kind").collect()  # of a fixed number
    sent = nodes.sparkSession.sparkContext.broadcast([(bytes(r.node), r.label, bytes(r.vec)) for r in rows])

    def make():
        true = np.zeros(len(sent.value), np.int64)
        group: dict[tuple, list[int]] = {}
        for i, (_, label, vec) in enumerate(sent.value):
            group.setdefault((label, len(vec)), []).append(i)

        def step(batch: pa.RecordBatch | None):
            if batch is None:
                return {"i": list(range(len(true))), "links": true}
            place = {name: i for i, name in enumerate(batch.column("node").to_pylist())}
            copies, here = batch.column("copies").to_numpy(), defaultdict(list)
            for i, (label, x) in enumerate(zip(batch.column("label").to_pylist(), batch.column("vec"))):
                if (label, len(x.as_buffer())) in group:
                    here[label, len(x.as_buffer())].append(i)
            for key, at in here.items():
                at, asked_here = np.array(at), group[key]
                base = matrix(batch.column("vec").take(pa.array(at)))
                query = matrix(pa.array([sent.value[i][2] for i in asked_here]))
                linked = cosines(query, base) >= threshold
                for row, i in enumerate(asked_here):
                    linked[row, at == place.get(sent.value[i][0], -1)] = False
                true[asked_here] += linked @ copies[at]
            return None

        return step

    true = {r.i: r.links for r in map_batches(nodes, make, "i int, links bigint", last=True)
            .groupBy("i").agg(F.sum("links").alias("links")).collect()}
    drawn = Counter(r.kind for r in rows)
    found, whole = Counter(), Counter()
    for i, r in enumerate(rows):
        if true[i]:
            judged, weight = (r.bits > 0, true[i] > k), there[r.kind] / drawn[r.kind]
            found[judged] += weight * min(r.linked, true[i]) / true[i]
            whole[judged] += weight
    return min((found[x] / whole[x] for x in whole), default=1.0)


def near_components(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str | None = "label", k: int = NEIGHBOURS,
                    audited: int = AUDITED, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id, kept) of every row of ``vectors``.

    Rows of one label (any, without ``label_col``) link when their cosine is ``threshold`` or more.  Null, empty and
    zero vectors, those with null or non-finite components and rows with a null label link with nothing and are their
    own components; vectors of different lengths never link.  Repeated rows link with each other.  A null id is never
    kept and lends a component no id.  An empty table gives an empty result.
    """
    if label_col is None:
        vectors, label_col = vectors.withColumn("_label", F.lit("")), "_label"
    rows = fold(vectors, id_col, vector_col, label_col)
    usable = rows.filter("node is not null")
    nodes = usable.groupBy("node", "label", "vec").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    nodes = materialize(with_bits(nodes, usable), "nn-nodes")
    links, done, orders, turn = None, 0, ORDERS, 0
    while True:
        fresh = None
        for order in range(done, orders):
            found = window_links(nodes, order, k, threshold)
            fresh = found if fresh is None else fresh.unionByName(found)
        fresh = materialize(fresh, "nn-windows")
        links = fresh if links is None else links.unionByName(fresh)
        while True:
            part = components(links.filter(F.col("sim") >= threshold).select("a", "b"))
            lists = materialize(best(links, part, k), "nn-lists")
            new = materialize(join_neighbours(lists, nodes, part, k, turn), "nn-joined")
            links, turn = links.unionByName(new), turn + 1
            if not new.filter(F.col("sim") >= threshold).limit(1).count():  # each such link joins two components
                break
        counts = count_links(nodes, part, threshold)
        done = orders
        reached = audit(nodes, counts, threshold, audited, k)
        if reached >= recall:
            break
        if done >= MOST_ORDERS:
            raise RuntimeError(f"near_components: recall {reached:.4f} after {done} orders, {recall} is asked for")
        orders = min(MOST_ORDERS, 2 * orders)
    placed = (nodes.join(part, "node", "left").join(counts, "node", "left")
              .select("node", F.coalesce("component", "node").alias("component"), "first",
                      (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")))
    placed = materialize(placed, "nn-placed")
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    final = materialize(placed.join(least, "component").select("node", "n_links", "component_id"), "nn-final")
    alone = F.col("node").isNull()
    out = rows.join(final, "node", "left").select(
        F.col("id").alias(id_col), F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))

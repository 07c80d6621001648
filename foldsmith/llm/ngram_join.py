"""Exact Jaccard self-join of documents on word n-grams, to connected components.

Equal sets fold into one class first.  The n-grams of a class are ordered rarest first, by a count sketch over all
documents; two sets with Jaccard ``percent`` / 100 or more must share one of their first ``n - ceil(t n) + 1``, so only
these prefixes are joined.  Length, positional and suffix filters discard pairs by numbers alone; each pair that is
left is verified once, on the full sets.

Lists of a shared n-gram are never expanded into all pairs.  First every class meets one hub of its list, the one that
has the fewest rarer n-grams, hence the most central of near copies; classes that link become one component.  Then
only pairs of classes that are in different components are joined, so a group of near copies costs a link per member.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, materialize, spread
from .common import map_batches, utf8
from .components import components

SKETCH_BITS = 20
SKETCH_ROWS = 64  # the sketch travels in so many pieces
PARTS = 32  # hash classes of the suffix filter
MOST_BROADCAST = 1_000_000  # ids of documents to compare that are sent to all executors; more are joined by shuffle


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the text's word n-grams, sorted; shorter texts have one, of all their words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    count = len(words) - width + 1
    out = np.full(count, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k:k + count]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def set_digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def fingerprints(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts: rows (id, n, digest) of the documents, and rows (piece, counts) of the sketch."""
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = rows.schema["id"].dataType.simpleString()
    id_type = pa.int64() if kind == "bigint" else None

    def make():
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)

        def step(batch: pa.RecordBatch | None):
            if batch is None:
                pieces = [sketch.reshape(SKETCH_ROWS, -1)[k].tobytes() for k in range(SKETCH_ROWS)]
                empty = [None] * SKETCH_ROWS
                return {"id": pa.nulls(SKETCH_ROWS, id_type), "n": empty, "digest": empty,
                        "piece": list(range(SKETCH_ROWS)), "counts": pieces}
            sizes, digests = [], []
            for text in utf8(batch.column("text")):
                grams = shingle_hashes(text, size)
                np.add.at(sketch, (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                sizes.append(len(grams))
                digests.append(set_digest(grams) if len(grams) else None)
            empty = [None] * len(sizes)
            return {"id": batch.column("id"), "n": sizes, "digest": digests, "piece": empty, "counts": empty}

        return step

    return materialize(map_batches(rows, make, f"id {kind}, n bigint, digest binary, piece int, counts binary",
                                   last=True), "grams-pass")


def read_sketch(seen: DataFrame) -> np.ndarray:
    """The summed counts of all tasks: 2 ** SKETCH_BITS numbers, whatever the input's size."""
    def make():
        sums: dict[int, np.ndarray] = {}

        def step(batch: pa.RecordBatch | None):
            if batch is None:
                return {"piece": list(sums), "counts": [v.tobytes() for v in sums.values()]}
            for piece, counts in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist()):
                counts = np.frombuffer(counts, np.uint32 if len(counts) == 4 << SKETCH_BITS >> 6 else np.uint64)
                sums[piece] = sums.get(piece, 0) + counts.astype(np.uint64)
            return None

        return step

    pieces = seen.filter(F.col("piece").isNotNull()).select("piece", "counts")
    for _ in range(2):  # within partitions, then per piece
        pieces = map_batches(pieces, make, "piece int, counts binary", last=True).repartition(SKETCH_ROWS, "piece")
    out = np.zeros(1 << SKETCH_BITS, np.uint64).reshape(SKETCH_ROWS, -1)
    for row in pieces.collect():
        out[row.piece] += np.frombuffer(row.counts, np.uint64)
    return out.reshape(-1)


def prefixes(docs: DataFrame, sketch: np.ndarray, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Second pass: (digest, n, grams, parts) of every document with words; grams is its prefix, rarest first."""
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    # only the order matters: counts become ranks of two bytes' worth of steps on a log scale
    sent = docs.sparkSession.sparkContext.broadcast(np.minimum(
        np.log2(sketch.astype(np.float64) + 1) * 1000, 65535).astype(np.uint16))

    def make():
        rarity = sent.value

        def step(batch: pa.RecordBatch):
            out = {n: [] for n in ("digest", "n", "grams", "parts")}
            for text in utf8(batch.column("text")):
                grams = shingle_hashes(text, size)
                n = len(grams)
                if not n:
                    continue
                order = np.lexsort((grams, rarity[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
                out["digest"].append(set_digest(grams))
                out["n"].append(n)
                out["grams"].append(grams[order[:prefix_length(n, percent)]].view(np.int64))
                out["parts"].append(np.bincount((grams % np.uint64(PARTS)).astype(np.int64),
                                                minlength=PARTS).astype(np.int32))
            return out

        return step

    return map_batches(rows, make, "digest binary, n bigint, grams array<bigint>, parts array<int>")


def needed(na, nb, percent: int):
    """The least intersection of two linked sets: 100 i >= p (na + nb - i)."""
    return F.ceil(F.lit(percent) * (na + nb) / F.lit(100 + percent))


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of classes those that link, compared on the full sets of their texts (class, text)."""
    left = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("class").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def make():
        def step(batch: pa.RecordBatch):
            keep, before, y = [], None, None
            for ta, tb in zip(utf8(batch.column("ta")), utf8(batch.column("tb"))):
                x = shingle_hashes(ta, size)
                if tb != before:  # rows come sorted by b
                    before, y = tb, shingle_hashes(tb, size)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            kept = pa.array(keep, pa.bool_())
            return {"a": batch.column("a").filter(kept), "b": batch.column("b").filter(kept)}
        return step

    return map_batches(both, make, "a bigint, b bigint")


def texts_of(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, id_col: str,
             text_col: str) -> DataFrame:
    """(class, text) of one document of every class in ``pairs``; only these texts are moved."""
    needed_classes = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted = materialize(needed_classes.join(classes, "class")
                         .select("class", "digest", F.col("first").alias("wanted")), "gram-wanted")
    if wanted.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    picked = rows.join(wanted, F.equal_null("id", "wanted")).select("class", "digest", "text")

    def make():  # ids may repeat: a text must have the digest it stands for
        def step(batch: pa.RecordBatch):
            mine = [set_digest(shingle_hashes(t, size)) for t in utf8(batch.column("text"))]
            same = pa.array([a == b for a, b in zip(mine, batch.column("digest").to_pylist())], pa.bool_())
            return {n: batch.column(n).filter(same) for n in ("class", "text")}
        return step

    return materialize(map_batches(picked, make, "class bigint, text string"), "gram-texts")


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id",
                       text_col: str = "text", with_digest: bool = False) -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``; ``with_digest`` adds the digest of its set.

    Two rows link when 100 times the intersection of their sets is ``percent`` times the union or more; component_id
    is the smallest id reachable by links.  A row without words has an empty set, links with nothing and is its own
    component.  Rows with a null id link like others but lend no id; a component of such rows only has a null
    component_id.  Repeated rows are returned as often as they occur.  An empty table gives an empty result.

    Inside, a class of equal sets goes by a number, given where its prefix is stored; lists, pairs and links then
    carry eight bytes a class instead of its digest.
    """
    seen = fingerprints(docs, size, id_col, text_col)
    rows = seen.filter(F.col("piece").isNull()).select("id", "n", "digest")
    sketch = read_sketch(seen)
    # one row per class; copies have equal rows, so any of them will do
    every = prefixes(docs, sketch, size, percent, id_col, text_col)
    cards = materialize(every.dropDuplicates(["digest"]).withColumn("class", F.monotonically_increasing_id()),
                        "gram-prefixes")
    firsts = rows.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("first"))
    classes = materialize(firsts.join(cards.select("digest", "class"), "digest"), "gram-classes")
    entries = cards.select("class", F.col("n").cast("int").alias("n"), F.posexplode("grams").alias("pos", "gram"))
    shared = materialize(entries.groupBy("gram").agg(F.count("*").alias("c"), F.min("pos").alias("least"))
                         .filter("c > 1").select("gram", "least"), "gram-shared")
    lists = materialize(entries.join(shared, "gram"), "gram-lists")
    forget(shared)
    hubs = materialize(lists.filter("pos = least").groupBy("gram")
                       .agg(F.min("class").alias("hub"), F.min_by("n", "class").alias("hub_n")), "gram-hubs")

    def sized(na, nb, pa_, pb):
        least = needed(na, nb, percent)
        return ((F.lit(100) * F.least(na, nb) >= F.lit(percent) * F.greatest(na, nb))
                & (F.least(na - pa_, nb - pb) >= least))

    first = (lists.join(hubs, "gram").filter(F.col("class") != F.col("hub"))
             .filter(sized(F.col("n"), F.col("hub_n"), F.col("pos"), F.col("least")))
             .select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct())
    tried = materialize(suffix_filter(first, cards, percent), "gram-hub-pairs")
    forget(hubs)
    texts = texts_of(tried, docs, classes, size, id_col, text_col)
    links = materialize(verify(tried, texts, size, percent), "gram-links")
    forget(texts)
    part = components(links)
    # what is left: pairs of a list that are not in one component and were not tried yet
    placed = (lists.select("gram", "class", "n", "pos").join(part.withColumnRenamed("node", "class"), "class", "left")
              .withColumn("component", F.coalesce("component", "class")))
    mixed = placed.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    open_lists = materialize(placed.join(mixed.select("gram"), "gram"), "gram-open")
    forget(lists)
    l, r = open_lists.alias("l"), open_lists.alias("r")
    rest = (l.join(r, (F.col("l.gram") == F.col("r.gram")) & (F.col("l.class") < F.col("r.class"))
                   & (F.col("l.component") != F.col("r.component"))
                   & sized(F.col("l.n"), F.col("r.n"), F.col("l.pos"), F.col("r.pos")))
            .select(F.col("l.class").alias("a"), F.col("r.class").alias("b")).distinct()
            .join(tried, ["a", "b"], "left_anti"))
    rest = materialize(suffix_filter(rest, cards, percent), "gram-rest-pairs")
    forget(open_lists, tried, cards)
    late = verify(rest, texts_of(rest, docs, classes, size, id_col, text_col), size, percent)
    whole = components(materialize(links.unionByName(late), "gram-all-links"))
    named = (classes.join(whole.withColumnRenamed("node", "class"), "class", "left")
             .withColumn("component", F.coalesce("component", "class")))
    least = materialize(named.groupBy("component").agg(F.min("first").alias("component_id")), "gram-least")
    final = materialize(named.select("digest", "component").join(least, "component").select("digest", "component_id"),
                        "gram-final")
    return (rows.join(final, "digest", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
                    *["digest"] * with_digest))


def one_of_each(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every component, that with the smallest id; of rows without words, every distinct id.

    Of repeated rows one stays.  Components of rows with null ids only keep one of them.
    """
    found = jaccard_components(docs, size, percent, id_col, text_col, with_digest=True)
    found = materialize(found.withColumnRenamed(id_col, "_id"), "gram-found")
    repeated = materialize(found.groupBy("_id").agg(F.count("*").alias("c")).filter("c > 1 or _id is null").select("_id"),
                           "gram-repeated")
    gone = materialize(found.filter("_id <> component_id").select("_id").distinct().unionByName(repeated).distinct(),
                       "gram-gone")
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    plain = docs.join(gone, F.equal_null(docs[id_col], gone["_id"]), "left_anti")
    if not repeated.limit(1).count():
        return plain
    # rows whose id does not tell them apart are told apart by their set
    odd = docs.join(repeated, F.equal_null(docs[id_col], repeated["_id"]), "left_semi")
    names, kinds = odd.columns, [f.dataType.simpleString() for f in odd.schema]
    at = names.index(text_col)

    def make():
        def step(batch: pa.RecordBatch):
            out = {f"c{k}": batch.column(k) for k in range(batch.num_columns)}
            grams = [shingle_hashes(t, size) for t in utf8(batch.column(at))]
            return out | {"mine": [set_digest(g) if len(g) else b"" for g in grams]}
        return step

    ddl = ", ".join(f"c{k} {kind}" for k, kind in enumerate(kinds)) + ", mine binary"
    marked = map_batches(odd.toDF(*[f"c{k}" for k in range(len(names))]), make, ddl)
    own = f"c{names.index(id_col)}"
    groups = found.select(F.coalesce("digest", F.lit(b"")).alias("mine"), "_id", "component_id").distinct()
    groups = groups.filter(F.equal_null("_id", "component_id")).select("mine", F.col("_id").alias("own"))
    kept = (marked.join(groups, (marked["mine"] == groups["mine"]) & F.equal_null(marked[own], groups["own"]), "left_semi")
            .dropDuplicates([own, "mine"]))
    return plain.unionByName(kept.drop("mine").toDF(*names))


def suffix_filter(pairs: DataFrame, cards: DataFrame, percent: int) -> DataFrame:
    """Drop pairs whose sets differ too much in size within the hash classes: their difference is at least the sum."""
    one = cards.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("parts").alias("xa"))
    two = cards.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("parts").alias("xb"))
    apart = F.aggregate(F.zip_with("xa", "xb", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    both = pairs.join(one, "a").join(two, "b")
    return both.filter(F.col("na") + F.col("nb") - 2 * needed(F.col("na"), F.col("nb"), percent) >= apart).select("a", "b")

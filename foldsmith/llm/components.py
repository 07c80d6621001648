"""Connected components of a table of links, by alternating star operations.

Every round replaces links by links to smaller nodes of the same component, with sums over hashed groups only; a hub's
links are combined before they are shuffled.  Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): the smallest node it is connected with.

    Links to oneself, null ends and repeated links are ignored; no links give an empty result.
    """
    kept = links.filter(F.col("a") != F.col("b"))
    # from the larger node down to the smaller
    stars = materialize(kept.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    while True:
        # large star: the larger neighbours of a node go to its smallest neighbour
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        least = materialize(least, "cc-least")
        large = (stars.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u")
                 .select(F.col("w").alias("u"), F.col("m").alias("v")))
        # a node's own smallest neighbour, if smaller, stays linked through the star of that neighbour
        own = least.filter(F.col("m") < F.col("u")).select("u", F.col("m").alias("v"))
        large = materialize(large.unionByName(own).filter("u <> v").distinct(), "cc-large")
        # small star: all smaller neighbours of a node, and the node, go to the smallest of them
        root = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "cc-root")
        moved = large.join(root.filter("n > 1").select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(root.select("u", F.col("m").alias("v")).unionByName(moved).filter("u <> v").distinct(), "cc")
        # done when every node has one link and no target has a link itself
        open_nodes = (new.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
                      or new.select("v").distinct().join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
                      .limit(1).count())
        forget(stars, least, large, root)
        stars = new
        if not open_nodes:
            break
    found = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return materialize(found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()), "cc-out")

"""Connected components of a table of links, by contraction; links and labels stay in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _round(links: DataFrame, number: int) -> DataFrame:
    """node, to: of each node the first of itself and its neighbours, by id in even rounds and by a hash of the round in odd ones."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    place = lambda c: F.struct((F.lit(0).cast("long") if number % 2 == 0 else F.xxhash64(c, F.lit(number))).alias("h"), F.col(c).alias("id"))
    near = both.groupBy(F.col("a").alias("node")).agg(F.min(place("b")).alias("low"))
    return near.select("node", F.least(place("node"), "low")["id"].alias("to"))


def connected(links: DataFrame) -> DataFrame:
    """links: a, b. Returns node, label for each node of a link: the smallest node that it reaches.

    Each round maps every node to one of itself and its neighbours and renames the links; links within a node
    vanish. Rounds by id take a star whose centre is its smallest node at once, but of a path in order of ids only
    one end; rounds by hash leave at most three quarters of the nodes of any shape in expectation, so the
    rounds grow with the logarithm of the links. Then the rounds' maps are composed backwards, and each group takes its smallest node.
    """
    links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    maps = []
    while not links.isEmpty():
        near = written(_round(links, len(maps)), "component-map")
        maps.append(near)
        x, y = near.select(F.col("node").alias("a"), F.col("to").alias("x")), near.select(F.col("node").alias("b"), F.col("to").alias("y"))
        links = links.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        links = written(links, "links")
    if not maps:
        kind = links.schema["a"].dataType
        return links.select(F.col("a").cast(kind).alias("node"), F.col("b").alias("label"))
    out = maps[-1].select("node", F.col("to").alias("label"))
    for near in reversed(maps[:-1]):
        up = out.select(F.col("node").alias("to"), "label")
        out = written(near.join(up, "to", "left").select("node", F.coalesce("label", "to").alias("label")), "component-labels")
    if len(maps) > 1:
        least = out.groupBy("label").agg(F.min("node").alias("least"))
        out = written(out.join(least, "label").select("node", F.col("least").alias("label")), "component-labels")
    return out

"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) of links (a, b): root is the smallest node that can be reached.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends and contracts the links; no component
    is gathered, and a chain shrinks by half a round at least.
    """
    links = stored(links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).distinct())
    known = stored(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    while not links.isEmpty():
        hooks = stored(links.groupBy("a").agg(F.least("a", F.min("b")).alias("to")))
        while True:
            ends = hooks.select(F.col("a").alias("to"), F.col("to").alias("end"))
            moved = stored(hooks.join(ends, "to").select("a", F.col("end").alias("next"), (F.col("end") != F.col("to")).alias("moved")))
            hooks = moved.select("a", F.col("next").alias("to"))
            if moved.where("moved").isEmpty():
                break
        up = hooks.select(F.col("a").alias("root"), "to")
        known = stored(known.join(up, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        left, right = hooks.toDF("a", "ra"), hooks.toDF("b", "rb")
        links = stored(links.join(left, "a").join(right, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    return known

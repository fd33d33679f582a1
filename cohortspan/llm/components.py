"""Connected components of a link table, by alternating large and small stars (Kiveris and others)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import Steps


def connected_components(links: DataFrame, steps: Steps) -> DataFrame:
    """``node, label`` for every node of the links ``a, b``; the label is the least node of its component.

    Every round replaces links by links to smaller nodes until each node hangs on the least one. A hub
    meets its neighbours only in a minimum and in a join whose other side has one row per node, so no
    task gathers a hub.
    """
    edges, path = steps.store(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if not state["n"] or (state["n"], state["s"]) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        before = (state["n"], state["s"])
        # Large star: every larger neighbour of a node moves to the least node around it.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u")
            .join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        # Small star: a node and its smaller neighbours move to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(joined.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges, new = steps.store(small, "links")
        steps.remove(path)
        path = new

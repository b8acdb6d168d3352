"""Connected components by alternating large-star and small-star steps, with each step's edges staged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stages import discard, staged


def _hung(pairs: DataFrame, large: bool) -> DataFrame:
    """Neighbours hung on the least one. pairs has (u, v), one way round, u > v."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
    least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")  # staged: then Spark can split a hub's rows
    joined = both.join(least, "u")
    if large:
        found = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        found = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = staged(found.filter("u <> v").distinct(), "star")
    discard(least)
    return out


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of the links (a, b): component is the least id it is connected with."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        large = _hung(edges, True)
        small = _hung(large, False)
        discard(edges, large)
        edges = small
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).first()
        if now == before or not now["n"]:
            break
        before = now
    own = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(own)

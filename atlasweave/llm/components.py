"""Connected components: forests of parts of the links, then alternating large-star and small-star steps, each step's edges staged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, staged

#: Links that a task takes at once, 4 MB of them. More are dealt to more tasks.
PART = 1 << 18


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of some links but the least of its component, and that least one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        parent[max(x, y)] = min(x, y)
    for x, y in enumerate(parent):  # a parent is less than its child, so its own is known
        parent[x] = parent[y]
    least = nodes[np.array(parent, np.int64)]
    return nodes[nodes != least], least[nodes != least]


def _contracted(pairs: DataFrame) -> DataFrame:
    """(u, v), u > v: the stars of each partition's links (a, b), PART of them at a time with the stars found before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = v = np.zeros(0, np.int64)
        held, size = [], 0

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return stars(*[np.concatenate([own, *[x.column(k).to_numpy() for x in held]]) for k, own in enumerate((u, v))])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= PART:
                (u, v), held, size = joined(), [], 0
                if len(u) >= PART:  # no task holds more: others join what lies in several pieces
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                    u = v = np.zeros(0, np.int64)
        u, v = joined()
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return map_arrow(pairs.select("a", "b"), run, "u long, v long")


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least one. pairs has (u, v), one way round, u > v."""
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
    """(id, component) of every node of the links (a, b), staged: component is the least id it is connected with.

    Up to PART links are one task's, whose stars are the answer; no shuffle is needed. Of more, every task gives the stars
    of its own, and steps over all tasks join them.
    """
    links = links.select("a", "b").filter("a <> b")
    parts = links.count() // PART + 1
    edges = staged(_contracted(links.coalesce(parts)), "edges")
    before = None
    while parts > 1:
        large = _star(edges, True)
        small = _star(large, False)
        discard(edges, large)
        edges = small
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).first()
        if now == before or not now["n"]:
            break
        before = now
    own = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    labels = staged(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(own), "labels")
    discard(edges)
    return labels

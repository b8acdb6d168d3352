from __future__ import annotations

import hashlib
import random
from collections import defaultdict

from atlasweave.llm import dedup


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(5)
    base = ["", "a", "A", "É", "é", "same text", "SAME text", "x" * 40, "x" * 39 + "y", "x" * 100_000, None]
    rows = [(k, rng.choice(base)) for k in range(3000)] + [(9000 + k, "hot Text" if k % 2 else "HOT text") for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = dedup.exact_duplicates(df).collect()
        survivors = dedup.drop_exact_duplicates(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert sorted(r.doc_id for r in survivors) == sorted(r.doc_id for r in got if r.kept)


def test_odd_tables(spark):
    schema = "doc_id long, text string, keep_id string, kept int"
    rows = [(None, "n", "x", 1), (None, "n", "y", 2), (1, "t", None, None), (1, "t", "a", 3), (2, None, "b", 4), (3, "", "c", 5)]
    df = spark.createDataFrame(rows, schema).select("doc_id", "text")
    got = dedup.exact_duplicates(df).collect()
    assert len(got) == 6 and sum(r.kept for r in got) == 3
    assert {r.keep_id for r in got if r.doc_id in (2, 3)} == {3}
    assert dedup.exact_duplicates(df.limit(0)).count() == 0
    kept = dedup.drop_exact_duplicates(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "keep_id", "kept"] and kept.count() == 3
    marked = dedup.exact_duplicates(spark.createDataFrame(rows, schema))
    assert marked.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and marked.filter("kept").count() == 3

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasweave.llm import codes


def plain(rows, entries=256, rounds=4, parts=4):
    """All parts against all entries in every round; rows (id, label, vector)."""
    kept = [r for r in rows if r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    width = -(-max((len(r[2]) for r in kept), default=0) // parts) * parts
    whole = [[int(np.floor(1024 * x)) for x in r[2]] + [0] * (width - len(r[2])) for r in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][2]))[:entries]
    v = np.array(whole, object).reshape(len(kept), parts, width // parts)
    books = [[list(v[k, p]) for k in order] for p in range(parts)]

    def assigned():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[k, p], e, strict=True)), j) for j, e in enumerate(books[p])) for p in range(parts)] for k in range(len(kept))]

    for _ in range(rounds):
        at = assigned()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [v[k, p] for k in range(len(kept)) if at[k][p][1] == j]
                if mine:
                    books[p][j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = assigned()
    out = [(r[0], r[1], "".join(f"{j:02x}" for _, j in a), sum(d for d, _ in a)) for r, a in zip(kept, at, strict=True)]
    return sorted(out, key=str), [[list(map(int, e)) for e in b] for b in books]


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").withColumn("code", F.lit(1.5)).withColumn("rows", F.lit("r")).withColumn("vector", F.lit("v"))
    found, books = codes.compressed(df.repartition(3), "vec_id", "embedding", **how)
    assert found.columns == ["vec_id", "label", "rows", "vector", "code", "error"]
    return sorted(((r.vec_id, r.label, r.code, r.error) for r in found.collect()), key=str), books.tolist(), found


def odd_rows(seed, n):
    rng = np.random.default_rng(seed)
    rows = [(k, "ab"[k % 2] if k % 5 else None, rng.normal(0, 0.01 if k % 3 else 2, 8).tolist()) for k in range(n)]
    same = rows[3][2]
    rows += [(n + k, "hot", same) for k in range(n // 2)] + [rows[5], rows[6]]
    rows += [(None, "x", rows[1][2]), (None, "x", rows[2][2]), (-1, None, None), (-2, "n", [1.0, None]), (-3, "n", [float("nan")] * 8), (-4, "n", [float("inf")] * 8), (-5, "short", [0.5]), (-6, "none", [])]
    return rows


@pytest.mark.parametrize(("entries", "n"), [(256, 300), (5, 90), (1, 20), (256, 12)])
def test_equal_to_plain_rounds(spark, monkeypatch, entries, n):
    monkeypatch.setattr(codes, "BLOCK", 64)
    monkeypatch.setattr(codes, "STEP", 50)
    rows = odd_rows(entries, n)
    want, books = plain(rows, entries)
    found, got, frame = run(spark, rows, entries=entries)
    assert found == want and got == books
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    assert {(r.label, r.label_error) for r in codes.label_errors(frame, "label").collect()} == set(sums.items())


def test_nothing_to_compress(spark):
    for rows in ([], [(1, "a", None)]):
        found, books, _ = run(spark, rows)
        assert found == [] and codes.digest(np.array(books)) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    found, _, _ = run(spark, [(1, "a", []), (2, "a", [])])
    assert found == [(1, "a", "00000000", 0), (2, "a", "00000000", 0)]
    with pytest.raises(Exception, match="component"):
        run(spark, [(1, "a", [1e30])])


def test_heaps_give_up_only_what_drift_has_reached():
    rng = np.random.default_rng(2)
    vectors = (rng.normal(0, 300, (3000, 1, 4)) + rng.integers(0, 8, 3000)[:, None, None] * 2000).astype(np.int32)
    books = vectors[:32, 0][None].astype(np.int64)
    block, drift, compared = codes.Block.new(vectors, 32), np.zeros((1, 32)), []
    for _ in range(6):
        compared.append(block.assign(books, drift))
        at, own, _ = codes.nearest(vectors[:, 0], books[0])
        assert (block.labels[:, 0] == at).all() and block.errors(books).sum() == own.sum()
        new = np.array([vectors[at == j, 0].astype(np.int64).sum(0) // max((at == j).sum(), 1) if (at == j).any() else books[0, j] for j in range(32)])[None]
        drift = drift + codes._drifts(books, new)
        books = new
        again = codes.Block.load(dict(zip(("vectors", "labels", "sizes", "members", "keys"), block.stored(), strict=True)), 1, 32)
        assert all(heap[0] == min(heap) for h in again.heaps for j in range(32) if (heap := h._heap(j)))
        block = again
    assert compared[0] == 3000 and all(x < 3000 for x in compared[2:])


def test_large_components_are_compared_exactly():
    rng = np.random.default_rng(3)
    v = rng.integers(-(codes.LARGEST - 1), codes.LARGEST, (40, 3))
    at, own, _ = codes.nearest(v, v[:9] + 1)
    want = [min((sum((int(a) - int(b) - 1) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(v[:9])) for x in v]
    assert [j for _, j in want] == at.tolist()

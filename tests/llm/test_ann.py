from __future__ import annotations

import numpy as np

from atlasweave.llm import ann


def brute(rows, k=10, every=1):
    out = {}
    for i, v in rows:
        if i % every == 0:
            d = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True)))), j) for j, w in rows if j != i)
            out[i] = [j for _, j in d[:k]]
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 24))
    x = (centres[rng.integers(0, 8, 1500)] + 0.4 * rng.normal(size=(1500, 24))).astype(np.float32)
    x[700:900] = x[700]  # many copies of one vector
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    codes, model = ann.index(df)
    found = {}
    for r in ann.search(codes, model, codes.filter("id % 20 = 0").select("id", "vec"), block=16).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = brute(rows, every=20)
    got = {q: [v for _, v in sorted(r)] for q, r in found.items()}
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    recall = np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want])
    assert recall >= 0.99
    assert got[700] == [i for i in range(701, 711)]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [float("inf"), 0.0]), (1, [0.9, 0.1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 1)]
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.filter("vec_id = 0")).count() == 0


def test_codes_estimate_within_bounds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 64))
    model = ann.fit(x[:500], 64)
    near, code, length, fits = model.encode(x)
    q = rng.normal(size=64)
    signs = np.unpackbits(code, axis=1, count=64) * 2.0 - 1
    rotated = np.array([model.matrix @ (q - model.centroids[c]) for c in near])
    true = ((x - model.centroids[near]) * (q - model.centroids[near])).sum(1)
    estimate = length * (signs * rotated).sum(1) / 8 / fits
    slack = length * np.sqrt(1 - fits**2) / fits * ann.WIDTH / np.sqrt(63) * np.sqrt((rotated**2).sum(1))
    assert (np.abs(estimate - true) <= slack).mean() > 0.995


def test_products_from_packed_bits():
    rng = np.random.default_rng(4)
    for dim in (1, 7, 8, 13, 64):
        x, q = rng.normal(size=(300, dim)), rng.normal(size=(5, dim))
        got = ann.code_products(np.packbits(x > 0, axis=1), q)
        assert np.allclose(got, np.where(x > 0, 1.0, -1.0) @ q.T, atol=1e-4)

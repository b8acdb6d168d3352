from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from atlasweave.llm import lm


def rows():
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re") for b in ("ta", "so", "ing", "er", "")]
    follow = {w: rng.sample(words, 4) for w in words}
    out = []
    for k in range(600):
        text, w = [], rng.choice(words)
        for _ in range(rng.randint(1, 60)):
            text.append(w.upper() if rng.random() < 0.05 else w)
            w = rng.choice(follow[w]) if rng.random() < 0.9 else f"rare{rng.randrange(400)}"
            w = w if w in follow else rng.choice(words)
        if k % 9 == 0:
            text.append(f"odd{k}")
        out.append((k, " ".join(text)))
    return [*out, (1000, ""), (1001, None), (1002, "word " * 20_000), (None, "null id"), (7, "seven again")]


def check(got, data):
    def tokens(t):
        return [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b""]

    count = Counter()
    for i, t in data:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for _, t in data)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}


@pytest.mark.parametrize("head", [lm.HEAD, 16])
def test_counts_and_scores(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    data = rows()
    df = spark.createDataFrame([(*r, 1.0, "x") for r in data], "doc_id long, text string, score double, n_known string")
    model, vocab = lm.fit(df)
    got = lm.scored(df, model, vocab).collect()
    check(got, data)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    table = {r.doc_id: r.score for r in got}
    monkeypatch.setattr(lm, "HEAD", lm.HEAD)
    assert len(table) == len({i for i, _ in data})


def test_cell_shares_add_up(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    model, vocab = lm.fit(df)
    buckets = [np.arange(50, dtype=np.uint16)] * 4
    p, q, many = model.chances(np.full(50, lm.CELLS - 1), buckets, buckets[:2])
    assert p.sum(1) == pytest.approx(1, abs=1e-5) and q.sum(1) == pytest.approx(1, abs=1e-5) and len(many) == 50
    table = vocab.toPandas()
    h, ending = table.h.to_numpy().view(np.uint64), table.ending.to_numpy().astype(np.int64)
    cell, _ = model.head.cells(lm.Tokens(h, ending, np.array([0, len(h)])))
    inside = 10 ** model.inside(table.c.to_numpy(), cell)
    for k in range(lm.CELLS):
        if model.mass[k]:
            seen = inside[cell == k].sum()
            assert seen <= 1 + 1e-9
            assert k < lm.SINGLE * lm.SUBS or seen == pytest.approx(1 - lm.DISCOUNT * (cell == k).sum() / model.mass[k])
    assert len(model.progress) == lm.ROUNDS and model.progress[-1] > model.progress[0]  # on texts new to the model at each step


def test_query_scores_are_direct_sums(spark):
    """The registered query against a token by token sum of class, subclass and share in the cell."""
    from atlasweave.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model, vocab = lm.fit(docs)
    counts = {np.uint64(np.int64(r.h).view(np.uint64)): r.c for r in vocab.collect()}
    got = {r.doc_id: r for r in queries.op10_lm_scores(spark, sf).collect()}
    data = {r.doc_id: r.text for r in docs.collect()}
    check(got.values(), list(data.items()))
    for i, text in data.items():
        t = lm.tokens(pa.array([text], pa.string()))
        cell, rank = model.head.cells(t)
        features, subs = lm.contexts(t, rank)
        total = 0.0
        for k in range(len(cell)):
            logit = model.prior.astype(float) + sum(model.weights[f[k]].astype(float) for f in features)
            kind, sub = divmod(int(cell[k]), lm.SUBS)
            total += (logit[kind] - math.log(sum(math.exp(x) for x in logit))) / math.log(10)
            if kind >= lm.SINGLE:
                logit = model.sub_prior[kind].astype(float) + sum(model.sub_weights[f[k], kind].astype(float) for f in subs)
                total += (logit[sub] - math.log(sum(math.exp(x) for x in logit))) / math.log(10)
            c = counts.get(t.hash[k])
            total += math.log10((c - model.discount[cell[k]]) / model.mass[cell[k]]) if c else model.unseen[cell[k]]
        assert got[i].score == pytest.approx(total, rel=1e-4), i


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    model, vocab = lm.fit(df)
    assert lm.scored(df, model, vocab).count() == 0
    one = spark.createDataFrame([(1, "never seen")], "doc_id long, text string")
    r = lm.scored(one, model, vocab).first()
    assert r.n_tokens == 3 and r.n_known == 0 and r.base_score == pytest.approx(0.0) and math.isfinite(r.score)

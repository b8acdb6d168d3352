"""Registered queries over the smallest tables against plain Python versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

from atlasweave.llm import quality, queries, secrets, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_op1(spark, docs):
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    there = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = queries.op1_byte_bpe(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = there.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def _entropy_free_statistics(text):
    """Some of the statistics, from the text by split and count."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    sizes = [len(w.encode()) for w in words]
    n, some = len(words), max(len(words), 1)
    mean = sum(sizes) / some
    return {
        12: math.log1p(len(text.encode())), 13: math.log1p(n), 14: mean, 15: math.sqrt(max(sum(s * s for s in sizes) / some - mean**2, 0)), 16: sum(s > 20 for s in sizes) / some,
        17: sum(s == 1 for s in sizes) / some, 18: sum(a == b for a, b in zip(words, words[1:], strict=False)) / some, 19: len(set(words)) / some,
        20: len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1), 24: len(text.encode()) / (text.count("\n") + 1) / 1000,
    }


def test_op3(spark, docs):
    texts = [*docs.values(), "", "one", "a a a\nB b", "é ü " * 50]
    x = quality.statistics(pa.array(texts))
    assert x.shape[1] == quality.FEATURES
    for text, row in zip(texts, x, strict=True):
        for k, v in _entropy_free_statistics(text).items():
            assert row[k] == pytest.approx(v, rel=1e-4, abs=1e-6), (k, text[:40])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    learned = sorted(i for i, y in labels.items() if i in docs and y in (0, 1) and zlib.crc32(str(i).encode()) % 4 != 2)
    rows = quality.statistics(pa.array([docs[i] for i in learned]))
    y = np.array([labels[i] for i in learned], float)
    order = np.lexsort([y, *rows.T])
    trees = quality.grow(rows[order], y[order])
    got = queries.op3_quality(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        want = trees.score(quality.statistics(pa.array([docs[r.doc_id]])))[0]
        assert r.score == pytest.approx(want) and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_trees_split_as_an_exhaustive_search():
    """The root of the first tree against all features and bins."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)).astype(np.float32)
    y = (x[:, 2] + 0.3 * rng.normal(size=300) > 0.4).astype(float)
    trees = quality.grow(x, y)
    g, h = y - y.mean(), np.full(300, y.mean() * (1 - y.mean()))
    best = (-1.0, 0, 0.0)
    for f in range(4):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS)[1:-1])).astype(np.float32):
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) >= quality.LEAST:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + quality.RIDGE) for s in (left, ~left))
                best = max(best, (float(gain), f, float(cut)))
    root = int(trees.roots[0])
    assert trees.feature[root] == best[1] == 2 and trees.limit[root] == pytest.approx(best[2])


def test_repeated_labels_count_once(spark):
    docs = spark.createDataFrame([(k, "good words here " * (k % 7 + 1) if k % 2 else "x! " * (k % 5 + 1)) for k in range(200)], "doc_id long, text string")
    once = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    many = once.union(once).union(spark.createDataFrame([(1, 0), (None, 1), (3, None), (5, 9)], "doc_id long, quality int"))
    stats = quality.measured(docs)
    a, b = quality.fit(stats, once), quality.fit(stats, many)
    assert np.array_equal(a.value, b.value) and np.array_equal(a.feature, b.feature)


def _decided(docs):
    """Benjamini and Hochberg's rule a stratum at a time, over all candidates of the corpus."""
    base = {i: secrets.base_spans(t) for i, t in docs.items()}
    found = {i: secrets.candidates(t, base[i]) for i, t in docs.items()}
    by = defaultdict(list)
    for rows in found.values():
        for _, _, stratum, p in rows:
            by[stratum].append(p)
    limit = {}
    for stratum, ps in by.items():
        ps.sort()
        limit[stratum] = max((p for p in set(ps) if (p + 1) / secrets._BINS <= secrets.FALSE_DISCOVERIES * sum(q <= p for q in ps) / len(ps)), default=-1)
    return {i: sorted(base[i] + [(a, 3, b) for a, b, stratum, p in rows if p > limit[stratum]]) for i, rows in found.items()}


def test_op4(spark, docs):
    want = _decided(docs)
    for r in queries.op4_secrets(spark, SF).collect():
        assert r.spans == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want[r.doc_id]), r.doc_id


def test_secrets_of_odd_tables(spark):
    key = "".join("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"[(k * k * 7 + 11 * k) % 62] for k in range(40))
    rows = [(1, "token = " + "x" * 12, "b", 1), (2, None, None, 2), (3, "", "", 3), (3, "", "", 3), (4, "word " * 200_000 + "password: abcdefghijkl", "s", 4), (5, key, "c", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, candidates int")
    got = {r.doc_id: r for r in secrets.find_secrets(df).collect()}
    assert [tuple(s) for s in got[1].base] == [(0, 0, 20)] and got[2].spans == got[3].spans == []
    assert [(s.start, s.kind, s.end) for s in got[4].base] == [(1_000_000, 0, 1_000_022)]
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_battery_tells_text_from_random():
    rng = np.random.default_rng(2)
    random = [secrets.battery(rng.integers(0, 62, 40).tolist(), 62) for _ in range(300)]
    assert np.mean([p <= 0.05 for p in random]) <= 0.1  # about as many as the level says
    assert secrets.battery([k % 2 for k in range(40)], 62) < 1e-6 and secrets.battery(list(range(40)), 62) < 1e-3 and secrets.battery([7] * 40, 62) < 1e-6


def test_op6(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(table, spark.read.parquet(f"{SF}/labels.parquet"))
    got = queries.op6_toxicity(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        _, buckets = toxicity.ngrams(pa.array([docs[r.doc_id]]))
        want = 1 / (1 + math.exp(-(model.bias + float(model.weights[np.unique(buckets)].astype(float).sum()))))
        assert r.score == pytest.approx(want, abs=1e-6) and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_op7(spark, docs):
    got = queries.op7_mixing(spark, SF).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in docs.items()}
    total, taken, goal = Counter(), Counter(), {}
    for r in got:
        assert r.size == size[r.doc_id] and (r.taken == 0 or r.taken in (r.size, 2 * r.size, 3 * r.size))
        total[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = r.target
    for r in got:
        assert r.source_size == total[source[r.doc_id]]
    assert sum(goal.values()) == pytest.approx(sum(total.values()))
    for s, t in goal.items():
        assert t <= 3 * total[s] + 1e-6
        assert abs(taken[s] - t) <= 0.03 * t, s  # a source has ten texts here, which do not add up to every number
    assert sorted(map(tuple, queries.op7_mixing(spark, SF).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_op9(spark, docs):
    sets = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op9_ngram_join(spark, SF).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}

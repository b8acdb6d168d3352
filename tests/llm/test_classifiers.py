from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from atlasweave.llm import quality, toxicity


def corpus(spark, n=1200):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice("the of stone river house green light paper walking sound".split()) for _ in range(rng.randint(5, 80))]
        bad, toxic = k % 4 == 0, k % 7 == 0
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["scumbag", "vermin", "lowlife"]))
        rows.append((k, " ".join(words), "en", "src", 1))
        labels.append((k, int(not bad), int(toxic)))
    rows += [(5000, None, "en", None, 0), (5001, "", "en", None, 0), (None, "text", None, None, 0), (5002, "word " * 50_000, "en", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int"), spark.createDataFrame(labels + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = corpus(spark)
    stats = quality.measured(docs.select("doc_id", "text"))
    trees = quality.fit(stats, labels)
    got = {r.doc_id: r.score for r in quality.scores(stats, trees).collect()}
    assert len(got) == docs.count()
    held = [k for k in range(1200) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([(got[k] >= 0.5) == (k % 4 != 0) for k in held]) > 0.97
    again = {r.doc_id: r.score for r in quality.scored(docs, trees).collect()}
    assert got == pytest.approx(again)
    none = quality.fit(stats, labels.limit(0))
    assert {r.score for r in quality.scores(stats, none).collect()} == {0.5}
    assert quality.scored(docs.limit(0), trees).count() == 0


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = quality.grow(x, y)

    def walk(row):
        total = trees.start
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.limit[node] else trees.right[node]
            total += trees.value[node]
        return 1 / (1 + np.exp(-total))

    assert trees.score(x) == pytest.approx(np.array([walk(r) for r in x]))
    assert ((trees.score(x) > 0.5) == y).mean() > 0.95


def test_statistics_of_odd_texts():
    got = quality.statistics(pa.array(["", None, " ", "\n", "a", "É!"]))
    assert got.shape == (6, quality.FEATURES) and np.isfinite(got).all()
    assert not got[:2].any()
    assert quality.statistics(pa.array([], pa.string())).shape == (0, quality.FEATURES)


def test_toxicity(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.scored(docs.select("doc_id", "text"), model).collect()}
    held = [k for k in range(1200) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(got[k] >= 0.5) == (k % 7 == 0) for k in held]) > 0.97
    assert len(got) == docs.count()
    assert toxicity.fit(docs, labels.filter("toxic = 0")).weights.any() == np.False_
    assert toxicity.scored(docs.limit(0), model).count() == 0
    hot = docs.limit(1).withColumn("text", F.concat_ws(" ", F.lit("river " * 5000), F.lit("VERMIN"), F.lit("stone " * 5000)))
    assert toxicity.scored(hot, model).first().score > 0.5


def test_ngrams_against_brute_force():
    texts = ["Ab cd", "", None, "hello hello é-x", "a" * 30]

    def brute(text):
        raw = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in (text or "").encode())
        grams = set()
        for word in raw.split(b" "):
            piece = b" " + word + b" "
            for n in toxicity.LENGTHS:
                grams |= {piece[i : i + n] for i in range(len(piece) - n + 1)} if word else set()
        return grams

    text, bucket = toxicity.ngrams(pa.array(texts))
    assert [int((text == k).sum()) for k in range(len(texts))] == [len(brute(t)) for t in texts]

from __future__ import annotations

import random
import re
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from atlasweave.llm import ngram_join
from atlasweave.llm.components import connected_components


def sets_of(text, width):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width, num, den):
    sets = {i: sets_of(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and den * len(x & y) >= num * len(x | y):
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus():
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(3000)]
    rows = []
    for _ in range(60):
        words = rng.choices(vocab, k=rng.choice([1, 2, 5, 12, 20, 40, 90, 300]))
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(copy) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in copy))
    base = rng.choices(vocab, k=200)  # a large group of near copies
    for _ in range(350):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(200)] = rng.choice(vocab)
        rows.append(" ".join(copy))
    rows += ["", None, " \t", "one", "ONE", "one two", "x\x0by\x1cz", "long " * 5000]
    return list(enumerate(rows))


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_against_brute_force(spark, width, num):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.components(df, width=width, num=num).collect()}
    assert got == brute(rows, width, num, 100)


def test_drop_and_odd_tables(spark):
    rows = [(1, "a b c d e f", "x", 1), (2, "A b c d e f", "y", 2), (None, "a b c d e f", "z", 3), (4, None, "n", 4), (5, "", None, 5), (5, "", None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string, id int")
    kept = ngram_join.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.id for r in kept.collect()) == [1, 4, 5, 6]  # the row of a null id is a copy of the first
    assert ngram_join.components(df.limit(0)).count() == 0
    assert ngram_join.components(df.filter("doc_id IS NULL")).first().component_id is None


def test_signatures_lose_no_pair():
    rng = np.random.default_rng(1)
    for num in (80, 90):
        for n in (11, 14, 20, 27, 60, 150, 700):
            for _ in range(30):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                change = int(len(a) * (100 - num) / (100 + num))
                drop = rng.integers(0, change + 1)
                b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, change - drop, dtype=np.uint64)]))
                same = len(np.intersect1d(a, b))
                if same * 100 < num * (len(a) + len(b) - same):
                    continue
                sig, at = ngram_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), num, 100)
                assert same == len(a) == len(b) or np.intersect1d(sig[: at[1]], sig[at[1] :]).size, (num, n)


def test_tree_finds_what_the_bound_allows():
    rng = np.random.default_rng(2)
    counts = rng.poisson(3, size=(300, ngram_join.GROUPS))
    counts[100:200] = counts[0] + (rng.random((100, ngram_join.GROUPS)) < 0.05)
    n = counts.sum(1)
    tree = ngram_join.CountTree(n, counts)
    for q in range(0, 300, 7):
        at, bound = tree.near(n[q], counts[q], 90, 100)
        every = np.minimum(counts, counts[q]).sum(1)
        assert sorted(at) == np.flatnonzero(every * 190 >= 90 * (n + n[q])).tolist()
        assert (bound == every[at]).all()


def test_fine_counts_bound_the_overlap():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 3, 60, 300, 301, 5000, 6000, 40_000)]
    sets.append(np.concatenate([sets[5], sets[4]]))
    fine = ngram_join.FineCounts(pa.array([ngram_join.fine_counts(h, len(h) * ngram_join.FINEST) for h in sets], pa.binary()))
    assert (fine.coarse() == np.array([np.bincount((h % ngram_join.GROUPS).astype(np.int64), minlength=ngram_join.GROUPS) for h in sets])).all()
    for k, h in enumerate(sets):
        bound = fine.overlap(k, np.arange(len(sets)))
        assert all(b >= len(np.intersect1d(h, other)) for b, other in zip(bound, sets, strict=True))
        assert bound[k] == len(h) and bound.tolist() == [fine.pair(k, j) for j in range(len(sets))]
    assert fine.overlap(5, np.array([6]))[0] < 0.85 * 5000  # sets that share nothing look unlike


def test_counts_of_any_size_pack():
    for most, width in ((0, 0.5), (15, 0.5), (16, 1), (255, 1), (256, 2), (65_535, 2), (65_536, 4)):
        counts = np.array([most, *np.arange(ngram_join.GROUPS - 1) % 3])
        packed = ngram_join._packed(counts)
        assert len(packed) == 1 + width * ngram_join.GROUPS
        assert (ngram_join.FineCounts(pa.array([packed], pa.binary())).take(0) == counts).all()


def test_rows_of_one_id(spark):
    x, y = "a b c d e f g h", "p q r s t u v w"
    df = spark.createDataFrame([(2, x, "k"), (7, x, "k"), (7, y, "k"), (9, y + " z", "k"), (9, y, "k"), (9, y, "k")], "doc_id long, text string, p string")
    assert sorted((r.id, r.component_id) for r in ngram_join.components(df, num=80).collect()) == [(2, 2), (7, 2), (7, 7), (9, 7), (9, 7), (9, 7)]
    kept = ngram_join.drop_near_duplicates(df, width=3)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, x), (7, y)]


def test_size_classes_cover_all_strings():
    table = ngram_join.size_classes(80, 100)
    assert table[0][0] == 1 and all(a[3] + 1 == b[0] for a, b in zip(table, table[1:], strict=False))
    assert table[-1][3] >= 1 << 30


def test_words_of_odd_texts():
    h, offsets = ngram_join.shingles(pa.array(["a b c", None, "", "a  b\tc", "A\x0bB\x0cC", "a", "c b a", "x\xa0y z w"]), 3)
    assert np.diff(offsets).tolist() == [1, 0, 0, 1, 1, 1, 1, 1]
    assert h[0] == h[1] == h[2] != h[4]


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_digests_bound_the_overlap():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 1400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[:k], rng.integers(0, 1 << 63, more, dtype=np.uint64)])) for k, more in ((300, 0), (290, 20), (1000, 24), (1000, 30), (1300, 90), (1400, 0), (0, 1200))]
    n = np.array([len(h) for h in sets])
    bits = ngram_join.Digests(pa.array([ngram_join.digests(h) for h in sets], pa.binary()), n)
    assert (bits.coarse() == np.array([np.bincount((h % ngram_join.GROUPS).astype(np.int64), minlength=ngram_join.GROUPS) for h in sets])).all()
    for k, h in enumerate(sets):
        same = np.array([len(np.intersect1d(h, other)) for other in sets])
        over = bits.overlap(k, np.arange(len(sets))) - same
        assert (over >= 0).all() and over.max() < 40


def test_a_group_a_little_less_similar_gives_few_pairs(spark, monkeypatch):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(5000)]
    base, rows = rng.choices(vocab, k=200), []
    for k in range(500):  # three in four differ from all others by a little too much
        copy = list(base)
        for _ in range(rng.randint(0, 2) if k % 4 == 0 else rng.randint(4, 7)):
            copy[rng.randrange(200)] = rng.choice(vocab)
        rows.append((k, " ".join(copy)))
    given, cross_pairs = [], ngram_join._cross_pairs

    def counted(*args):
        pairs = cross_pairs(*args)
        given.append(pairs.count())
        return pairs

    monkeypatch.setattr(ngram_join, "_cross_pairs", counted)
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 3, 90, 100)
    assert sum(given) <= 2 * len(rows), given


def test_digests_take_a_byte_for_a_member():
    rng = np.random.default_rng(6)
    for n in (1, 2, 100, 1000, 3000, 40_000):
        h = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        packed = ngram_join.digests(h)
        assert len(packed) <= 1.25 * n + 4
        low = np.sort(h & np.uint64((1 << ngram_join.digest_bits(n)) - 1))
        assert (ngram_join.Digests(pa.array([packed], pa.binary()), np.array([n])).of[0] == low).all()


def test_only_buckets_that_gave_no_link_are_searched_again(spark, monkeypatch):
    """Two far groups of near copies: in one, pairs that some bits allow are no links; the other is done with after the first search."""
    rng = random.Random(9)
    vocab, rows = [f"w{k}" for k in range(5000)], []
    for base in (rng.choices(vocab, k=200), rng.choices(vocab, k=200)):
        for _ in range(120):
            copy = list(base)
            for _ in range(rng.randint(2, 6)):
                copy[rng.randrange(200)] = rng.choice(vocab)
            rows.append((len(rows), " ".join(copy)))
    searched, cross_pairs = [], ngram_join._cross_pairs

    def watched(*args):
        searched.append(args[-1] if len(args) == 7 else None)
        return cross_pairs(*args)

    monkeypatch.setattr(ngram_join, "_cross_pairs", watched)
    monkeypatch.setattr(ngram_join, "SPREAD", 2)  # few bits, so that they allow what is no link
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 3, 90, 100)
    assert searched[0] is None and len(searched) <= 2 and all(x is not None for x in searched[1:])


@pytest.mark.parametrize("part", [1 << 18, 4, 1])
def test_components_of_one_task_and_of_many(spark, monkeypatch, part):
    from atlasweave.llm import components

    monkeypatch.setattr(components, "PART", part)
    rng = random.Random(10)
    links = [(rng.randrange(90), rng.randrange(90)) for _ in range(50)] + [(k, k + 1) for k in range(200, 230)]
    parent = {x: x for pair in links if pair[0] != pair[1] for x in pair}
    for _ in parent:
        for a, b in links:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == parent


def test_two_points_meet_in_one_slice(spark, monkeypatch):
    """Each point goes to one slice for each block it is to meet, not to two; points of the main component don't meet each other."""
    monkeypatch.setattr(ngram_join, "SLICE", 8)
    labelled = spark.createDataFrame([(1, k, 0 if k < 20 else k) for k in range(70)], "group long, id long, component long")
    main = spark.createDataFrame([(1, 0, 7, 3)], "group long, main long, blocks int, mains int")
    slices = {}
    for r in ngram_join._slices(labelled, main).collect():
        slices.setdefault((r.i, r.j, r.inner), []).append((r.id, r.asks))
    met = Counter()
    for (i, j, inner), rows in slices.items():
        asking, there = [k for k, asks in rows if asks], [k for k, asks in rows if not asks]
        met.update((min(a, b), max(a, b)) for a in asking for b in there)
        met.update(combinations(sorted(asking), 2) if inner else ())
        assert i < 7 and i < j and inner == (j == 7)
    assert met == Counter(p for p in combinations(range(70), 2) if p[1] >= 20)
    assert sum(map(len, slices.values())) == 50 * (7 + 3 - 1) + 20 * 7


def test_slices_in_rounds(spark, monkeypatch):
    """Where slices send points too often for one round, rounds find what one does."""
    rng = random.Random(11)
    vocab, base, rows = [f"w{k}" for k in range(5000)], None, []
    base = rng.choices(vocab, k=200)
    for k in range(200):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(200)] = rng.choice(vocab)
        rows.append((k, " ".join(copy)))
    stages, staged = [], ngram_join.staged
    monkeypatch.setattr(ngram_join, "staged", lambda df, label: stages.append(label) or staged(df, label))
    monkeypatch.setattr(ngram_join, "SLICE", 16)
    monkeypatch.setattr(ngram_join, "ROUND", 1)
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 3, 90, 100)
    assert stages.count("searched") > 2 * stages.count("cross")


def test_a_written_stage_leaves_no_shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        names = blocks.getAllBlocks().mkString("\n").split("\n")
        return {x for x in names if x.startswith("shuffle_")}

    before = shuffled()
    kept = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    df = ngram_join.staged(spark.range(1000).groupBy((ngram_join.F.col("id") % 7).alias("k")).count(), "probe")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert df.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == kept

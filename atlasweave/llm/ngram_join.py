"""N-gram Jaccard join over count vectors.

A document is a set of word n-grams. Hashing them into groups makes the set a point of group counts, and two sets share at
most the sum of the coordinate minima. A packed R-tree over such points gives, for a point, the others whose bound
reaches what the similarity needs; pairs that survive are verified on the sets.

The points are dealt to tasks without losing a pair: sets as similar as asked differ in D members at most, so if the
hash space is cut into D + 1 + z ranges, z + 1 of them at least hold the same members in both. Each filled range gives a
signature of its members, and points that share a signature come to one bucket. (Signatures of empty ranges are given
only by sets with more than z empty ranges: their partners have as many.) Equal sets are one point from the start.

A share of the buckets gives a spanning forest of likely pairs first, and the links found join points to components; of the
other buckets only those whose points are still apart give one, between the components. Then buckets that are apart even so
and whose forests passed over pairs are searched in full, points outside the bucket's largest component against all others,
in bounded slices. So a large group of near copies is never expanded into all its pairs. What a tree finds is bounded once
more before it makes a pair: in forests by counts in groups whose number grows with the set, in slices by some low bits of
each member, which is nearly the overlap itself. There a pair is given only if no pair given before joins its components. A
pair that then turns out to be no link may have hidden others of its bucket: so buckets that gave such a pair, and no others,
are searched again, and all their pairs are given that such bits allow between what is still apart.

A document is named by a number made of its id and its text, so rows of one id with different texts are different points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fresh, map_arrow, mix, slices, span_hash, staged, utf8, words
from .components import connected_components

#: Groups of the count vectors that the trees index, and members of a set for each group of the finer vectors that buckets hold;
#: the finest, which bound pairs before sets are fetched, have so many groups for each member.
GROUPS, FINE, FINEST = 64, 4, 2
#: One bucket in so many is searched first.
FIRST = 8
#: Points in a chunk of a bucket; buckets up to SMALL give all their pairs at once.
CHUNK, SMALL, LEAF = 256, 3, 8
#: Points in a slice of the search between components, where sets are compared by some low bits of each member: so many values
#: of such bits for each member at least, but FEW_BITS and no more than MANY_BITS.
SLICE, SPREAD, FEW_BITS, MANY_BITS = 512, 64, 8, 24
#: How often a round of that search sends each point, on average.
ROUND = 8
_SIZES = 1.4  # ratio of the ends of a size class
_MULT = np.uint64(0x9E3779B97F4A7C15)


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word n-grams, A-Z lower-cased, and the n + 1 offsets of texts."""
    buf, offsets = utf8(column)
    low = buf.copy()
    low[(low >= 65) & (low <= 90)] += 32
    start, length, count = words(low, offsets)
    w = span_hash(low, start, length)
    ends = np.cumsum(count)
    h = w.copy()
    span = max(len(w) - width + 1, 0)
    for j in range(1, width):
        h[:span] = mix(h[:span] * _MULT + w[j : j + span])
    parts, sizes = [], np.zeros(len(count), np.int64)
    for k, (n, end) in enumerate(zip(count.tolist(), ends.tolist(), strict=True)):
        if n >= width:
            own = np.sort(h[end - n : end - width + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        elif n:
            own = np.array([n], np.uint64) * _MULT
            for x in w[end - n : end]:
                own = mix(own * _MULT + x)
        else:
            continue
        parts.append(own)
        sizes[k] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


@lru_cache(8)
def size_classes(num: int, den: int, most: int = 1 << 31) -> tuple[tuple[int, int, int, int], ...]:
    """(least size, ranges, spare ranges z, greatest size) of each class of set sizes, for similarity num / den.

    No string that Spark can hold has more words than the greatest class.
    """
    out, low = [], 1
    while low <= most:
        high = max(low, int(low * _SIZES))
        differ = 2 * high * (den - num) // (den + num)
        spare = 1
        while differ:
            ranges = differ + 1 + spare
            empty = math.exp(-low / ranges)
            if spare > 2 * differ + 8 or ranges * empty + 3.5 * math.sqrt(ranges * empty) <= spare + 0.2:
                break
            spare += max(1, spare >> 6)
        out.append((low, differ + 1 + spare if differ else 0, spare, high))
        low = high + 1
    return tuple(out)


def signatures(h: np.ndarray, offsets: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of each set, and the n + 1 offsets of sets among them."""
    table = size_classes(num, den)
    lows = np.array([c[0] for c in table])
    ranges, spare = np.array([c[1] for c in table]), np.array([c[2] for c in table])
    n = np.diff(offsets)
    first = np.searchsorted(lows, n, "right") - 1
    last = np.searchsorted(lows, n * den // num, "right") - 1
    owner = np.repeat(np.arange(len(n)), n)
    value = mix(h ^ np.uint64(0x5851F42D4C957F2D))
    found_doc, found_sig = [], []
    for step in range(int((last - first).max()) + 1 if len(n) else 0):
        c = first + step
        takes = (n > 0) & (c <= last) & (ranges[np.maximum(c, 0)] > 0)
        mine = takes[owner]
        if not mine.any():
            continue
        doc = owner[mine]
        m = ranges[c[doc]].astype(np.uint64)
        part = ((h[mine] >> np.uint64(32)) * m) >> np.uint64(32)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(new)
        sums = np.add.reduceat(value[mine], at)
        cell = c[doc[at]].astype(np.uint64) << np.uint64(40) | part[at]
        found_doc.append(doc[at])
        found_sig.append(mix(sums + mix(cell + _MULT)))
        filled = np.bincount(doc[at], minlength=len(n))
        for k in np.flatnonzero(takes & (ranges[c] - filled > spare[c])).tolist():
            absent = np.setdiff1d(np.arange(ranges[c[k]], dtype=np.uint64), part[at][doc[at] == k])
            found_doc.append(np.full(len(absent), k))
            found_sig.append(mix(mix((np.uint64(c[k]) << np.uint64(40) | absent) + _MULT)))
    if not found_doc:
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    doc, sig = np.concatenate(found_doc), np.concatenate(found_sig)
    order = np.argsort(doc, kind="stable")
    return sig[order], np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(n)))])


class CountTree:
    """A packed R-tree over count vectors: nodes keep the greatest counts and the least size of what is below them."""

    def __init__(self, n: np.ndarray, counts: np.ndarray):
        spread = counts.var(axis=0).argmax() if len(n) else 0
        order = np.argsort(n, kind="stable")
        slab = np.arange(len(n)) // (LEAF * 4)
        self.order = order[np.lexsort((counts[order, spread], slab))]
        high, least = counts[self.order], n[self.order]
        self.levels = [(high, least)]
        while len(high) > LEAF:
            cuts = np.arange(0, len(high), LEAF)
            high, least = np.maximum.reduceat(high, cuts), np.minimum.reduceat(least, cuts)
            self.levels.append((high, least))

    def near(self, n: int, counts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of points whose overlap may suffice, with the bounds of their overlaps."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, least = self.levels[depth]
            bound = np.minimum(high[at], counts).sum(axis=1)
            good = bound * (den + num) >= num * (least[at] + n)
            at, bound = at[good], bound[good]
            if depth:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at], bound


class FineCounts:
    """Count vectors of sets in 64 groups or more, the more the larger a set; two are compared in the fewer groups of both."""

    def __init__(self, column: pa.Array):
        rows = column.to_pylist()
        self.of = np.array([(len(r) - 1) * 2 if not r[0] else (len(r) - 1) // r[0] for r in rows], np.int64)
        self.at = np.zeros(len(rows), np.int64)
        self.tables: dict[int, np.ndarray] = {}
        for groups in np.unique(self.of).tolist():
            own = np.flatnonzero(self.of == groups)
            self.at[own] = np.arange(len(own))
            self.tables[groups] = np.stack([_unpacked(rows[k]) for k in own])

    def take(self, k: int) -> np.ndarray:
        return self.tables[int(self.of[k])][self.at[k]]

    def coarse(self) -> np.ndarray:
        """All of them in GROUPS groups."""
        out = np.empty((len(self.of), GROUPS), np.int64)
        for groups, table in self.tables.items():
            out[self.of == groups] = _folded(table, GROUPS)
        return out

    def pair(self, i: int, j: int) -> int:
        """At most so many members do two sets share."""
        a, b = self.take(i), self.take(j)
        if len(a) != len(b):
            least = min(len(a), len(b))
            a, b = _folded(a, least), _folded(b, least)
        return int(np.minimum(a, b).sum())

    def overlap(self, k: int, others: np.ndarray) -> np.ndarray:
        """At most so many members does set k share with each of the others."""
        mine, out = self.take(k), np.zeros(len(others), np.int64)
        for groups in np.unique(self.of[others]).tolist():
            own, least = self.of[others] == groups, min(groups, len(mine))
            out[own] = np.minimum(_folded(self.tables[groups][self.at[others[own]]], least), _folded(mine, least)).sum(axis=1)
        return out


def _folded(counts: np.ndarray, groups: int) -> np.ndarray:
    return counts.reshape(*counts.shape[:-1], -1, groups).sum(axis=-2)


def likely_pairs(n: np.ndarray, fine: FineCounts, num: int, den: int, part: np.ndarray | None = None) -> tuple[list[tuple[int, int]], bool]:
    """All pairs of a small bucket that may link; of a larger one a spanning forest of them, closest first.

    Pairs inside a part are left out, and parts are joined from the start. Also whether the forest passed over pairs whose
    points it had joined by others: if not, the bucket is done with.
    """
    counts = fine.coarse()
    tree, edges = CountTree(n, counts), []
    part = np.arange(len(n)) if part is None else part
    for i in range(len(n)):
        at, bound = tree.near(n[i], counts[i], num, den)
        later = (at > i) & (part[at] != part[i])
        edges += zip((n[i] + n[at[later]] - 2 * bound[later]).tolist(), [i] * int(later.sum()), at[later].tolist(), strict=True)
    _, parent = np.unique(part, return_inverse=True)
    of, parent = parent.tolist(), list(range(int(parent.max(initial=-1)) + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, passed_over = [], False
    for _, i, j in sorted(edges):
        a, b = root(of[i]), root(of[j])
        if a == b and len(n) > SMALL:
            passed_over = True
        elif fine.pair(i, j) * (den + num) >= num * (n[i] + n[j]):
            parent[b] = a
            out.append((i, j))
    return out, passed_over


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(id, p, n_shingles, h1, h2) of each row, staged: h1 and h2 name the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            h, offsets = shingles(batch.column(2), width)
            some = np.diff(offsets) > 0
            names = []
            for seed in (1, 2):
                total = np.zeros(batch.num_rows, np.uint64)
                if some.any():
                    total[some] = np.add.reduceat(mix(h ^ np.uint64(seed * 0xD1342543DE82EF95 & (1 << 64) - 1)), offsets[:-1][some])
                names.append(pa.array(total.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets)), *names], ["id", "p", "n_shingles", "h1", "h2"])

    return staged(map_arrow(texts, run, "id long, p long, n_shingles long, h1 long, h2 long"), "sets")


def _number(id_col: str, text_col: str, seed: int) -> Column:
    """A row's number. Rows alike in id and text share it."""
    return F.xxhash64(F.lit(seed), F.col(id_col).isNull(), F.col(id_col), F.col(text_col))


def _numbered(df: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), _number(id_col, text_col, seed).alias("p"), F.col(text_col).alias("text"))


def _signed(rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(sig, id) of each row (p, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            sig, at = signatures(*shingles(batch.column(1), width), num, den)
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(at))
            for i in range(0, len(sig), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(sig[i : i + 100_000].view(np.int64)), pa.array(ids[i : i + 100_000])], ["sig", "id"])

    return map_arrow(rows.select("p", "text"), run, "sig long, id long")


def _buckets(signed: DataFrame) -> DataFrame:
    """(sig, members, large): points that share a signature, in chunks; large where a bucket has several chunks."""
    rows = signed.repartition("sig").sortWithinPartitions("sig", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_sig, held = None, np.zeros(0, np.int64)  # the chunk that the last rows began
        large = False

        def emit(groups: list[tuple[int, np.ndarray, bool]]) -> pa.RecordBatch:
            sizes = np.array([0, *[len(g) for _, g, _ in groups]])
            members = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(np.concatenate([g for _, g, _ in groups])))
            return pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in groups], pa.int64()), members, pa.array([x for *_, x in groups])], ["sig", "members", "large"])

        for batch in batches:
            sig, ids = (batch.column(k).to_numpy() for k in (0, 1))
            if not len(sig):
                continue
            cuts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            ends = np.append(cuts[1:], len(sig))
            plural = (ends - cuts > 1) | (cuts == 0) | (ends == len(sig))
            out = []
            for a, b in zip(cuts[plural].tolist(), ends[plural].tolist(), strict=True):
                key, own = int(sig[a]), ids[a:b]
                if key == held_sig:
                    own = np.concatenate([held, own])
                else:
                    if held_sig is not None and (len(held) > 1 or large):
                        out.append((held_sig, held, large))
                    large = False
                while len(own) > CHUNK:
                    large = True
                    out.append((key, own[:CHUNK], True))
                    own = own[CHUNK:]
                held_sig, held = key, own
            if out:
                yield emit(out)
        if held_sig is not None and (len(held) > 1 or large):
            yield emit([(held_sig, held, large)])

    return staged(map_arrow(rows, run, "sig long, members array<long>, large boolean"), "buckets")


def _point_sets(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, n, fine, finest, digests, members) of the wanted numbers, from their texts; staged."""
    rows = texts.select("p", "text").join(wanted, texts["p"] == wanted["id"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            h, offsets = shingles(batch.column(1), width)
            fine, finest, bits, sets = [], [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                fine.append(fine_counts(h[a:b], (b - a) // FINE))
                finest.append(fine_counts(h[a:b], (b - a) * FINEST))
                bits.append(digests(h[a:b]))
                sets.append(h[a:b].tobytes())
            made = [pa.array(x, pa.binary()) for x in (fine, finest, bits, sets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), *made], ["id", "n", "fine", "finest", "digests", "members"])

    return staged(map_arrow(rows, run, "id long, n long, fine binary, finest binary, digests binary, members binary"), "points")


def digest_bits(n: int) -> int:
    """How many low bits of its members a set of n is compared by."""
    return min(max((n * SPREAD - 1).bit_length(), FEW_BITS), MANY_BITS)


def digests(members: np.ndarray) -> bytes:
    """The low bits of each member of a set in ascending order, as gaps: a byte for the rest of a gap, after one of 255 for each 255 in it."""
    low = np.sort(members & np.uint64((1 << digest_bits(len(members))) - 1)).astype(np.int64)
    gaps = np.diff(low, prepend=0)
    whole = gaps // 255
    out = np.full(len(gaps) + int(whole.sum()), 255, np.uint8)
    out[np.cumsum(whole + 1) - 1] = gaps % 255
    return out.tobytes()


class Digests:
    """The digests of many sets, to bound the overlaps of one with others."""

    def __init__(self, column: pa.Array, n: np.ndarray):
        self.n = n.astype(np.int64)
        self.bits = np.array([digest_bits(k) for k in self.n.tolist()], np.int64)
        self.of = []
        for x in column:
            gaps = np.frombuffer(x.as_buffer(), np.uint8)
            self.of.append(np.cumsum(gaps, dtype=np.int32)[gaps < 255])

    def coarse(self) -> np.ndarray:
        """Count vectors in GROUPS groups."""
        return np.stack([np.bincount(x & (GROUPS - 1), minlength=GROUPS) for x in self.of]) if self.of else np.zeros((0, GROUPS), np.int64)

    def overlap(self, k: int, others: np.ndarray) -> np.ndarray:
        """At most so many members does set k share with each of the others: so many of theirs have bits that one of its own has."""
        out = np.zeros(len(others), np.int64)
        bits = np.minimum(self.bits[others], self.bits[k])
        for few in np.unique(bits).tolist():
            own, mask = np.flatnonzero(bits == few), (1 << few) - 1
            has = np.zeros(mask + 1, bool)
            has[self.of[k] & mask] = True
            at = np.concatenate([[0], np.cumsum(self.n[others[own]])[:-1]])
            out[own] = np.add.reduceat(has[np.concatenate([self.of[t] for t in others[own].tolist()]) & mask], at, dtype=np.int64)
        return out


def fine_counts(members: np.ndarray, size: int) -> bytes:
    """A set's count vector, packed, in as many groups as size but rounded down to a power of two, GROUPS at least."""
    groups = max(GROUPS, 1 << max(size, 1).bit_length() - 1)
    return _packed(np.bincount((members & np.uint64(groups - 1)).astype(np.int64), minlength=groups))


def _packed(counts: np.ndarray) -> bytes:
    """Counts in half a byte each, or as many bytes as the greatest needs; that number, 0 for half a byte, comes first."""
    most = counts.max(initial=0)
    if most < 16:
        return b"\0" + (counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes()
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    if packed[0]:
        return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int32)
    both = np.frombuffer(packed, np.uint8, offset=1)
    return np.column_stack([both & 15, both >> 4]).ravel().astype(np.int32)


def _pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    table = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], ["a", "b"])


def _forest_pairs(buckets: DataFrame, points: DataFrame, num: int, den: int, labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b) of the buckets' forests, members of the buckets in which a forest passed over pairs, and the staged table of both.

    With labels (id, component), only buckets whose points are in several components are searched, between those.
    """
    lists = buckets.select("members").distinct().withColumn("group", F.xxhash64("members"))
    rows = lists.select("group", F.explode("members").alias("id"))
    if labels is None:
        rows = rows.withColumn("part", F.col("id"))
    else:
        rows = staged(rows.join(labels, "id", "left").select("group", "id", F.coalesce("component", "id").alias("part")), "parts")
        rows = rows.join(rows.groupBy("group").agg((F.min("part") < F.max("part")).alias("apart")).filter("apart"), "group", "left_semi")
    rows = rows.join(points.select("id", "n", "fine"), "id")
    groups = rows.groupBy("group").agg(F.collect_list(F.struct("id", "n", "fine", "part")).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            more: list[list[int]] = []
            for k in range(batch.num_rows):
                p = batch.column(0)[k].values
                ids, n = p.field("id").to_numpy(), p.field("n").to_numpy()
                pairs, passed_over = likely_pairs(n, FineCounts(p.field("fine")), num, den, p.field("part").to_numpy())
                found += [(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for i, j in pairs if ids[i] != ids[j]]
                more += [sorted(ids.tolist())] if passed_over else []
            table = np.array(found, np.int64).reshape(-1, 2)
            pad = [None] * len(more)
            columns = [pa.concat_arrays([pa.array(table[:, c]), pa.array(pad, pa.int64())]) for c in (0, 1)]
            members = pa.array([None] * len(found) + more, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns, members], ["a", "b", "members"])

    made = staged(map_arrow(groups.select("p"), run, "a long, b long, members array<long>"), "forest")
    return made.filter("a is not null").select("a", "b").distinct(), made.filter("members is not null").select("members").distinct(), made


def _bounded(pairs: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that the finest counts allow to be as similar as asked; staged."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    points = points.select("id", "n", "finest").join(asked, "id", "left_semi")
    left = points.select(F.col("id").alias("a"), F.col("n").alias("n1"), F.col("finest").alias("x"))
    right = points.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("finest").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n1, n2 = (batch.column(k).to_numpy() for k in range(4))
            found = []
            for k, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                x, y = _unpacked(x), _unpacked(y)
                least = min(len(x), len(y))
                if int(np.minimum(_folded(x, least), _folded(y, least)).sum()) * (den + num) >= num * int(n1[k] + n2[k]):
                    found.append((int(a[k]), int(b[k])))
            yield _pair_batch(found)

    return staged(map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "n1", "n2", "x", "y"), run, "a long, b long"), "bounded")


def _verified(pairs: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs, each given once, whose sets are as similar as asked. Only sets that are in a pair which the finest counts allow are dealt out."""
    allowed = _bounded(pairs, points, num, den)
    asked = allowed.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    points = points.join(asked, "id", "left_semi")
    left = points.select(F.col("id").alias("a"), F.col("members").alias("x"))
    right = points.select(F.col("id").alias("b"), F.col("members").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2), batch.column(3), strict=True):
                both = np.sort(np.concatenate([np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y)]))  # sets are read in place
                same = int((both[1:] == both[:-1]).sum())
                if den * same >= num * (len(both) - same):
                    found.append((a, b))
            yield _pair_batch(found)

    links = staged(map_arrow(allowed.join(left, "a").join(right, "b").select("a", "b", "x", "y"), run, "a long, b long"), "links")
    discard(allowed)
    return links


def _slices(labelled: DataFrame, main: DataFrame) -> DataFrame:
    """(group, id, component, i, j, asks, inner): the points of each slice (i, j), i < j, of a group of buckets.

    A group's points outside its main component are dealt to its first blocks, the others to `mains` more. A slice is two
    blocks, the first of them one that asks; in the slice with the first of the others (inner) it asks itself, too. So two
    points meet once, and a group of two blocks is sent once.
    """
    apart = labelled.join(main, "group").withColumn("h", F.xxhash64("id", "group")).withColumn("other", F.col("component") != F.col("main"))
    block = F.when(F.col("other"), F.pmod("h", F.col("blocks"))).otherwise(F.col("blocks") + F.pmod("h", F.col("mains")))
    meets = F.when(F.col("other"), F.col("blocks") + F.col("mains")).otherwise(F.col("blocks"))
    rows = apart.select("group", "id", "component", "blocks", block.cast("int").alias("block"), F.explode(F.sequence(F.lit(0), meets.cast("int") - 1)).alias("k")).filter("block <> k")
    return rows.select("group", "id", "component", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), (F.col("block") < F.col("k")).alias("asks"), (F.greatest("block", "k") == F.col("blocks")).alias("inner"))


def _cross_pairs(buckets: DataFrame, open_: DataFrame, points: DataFrame, labels: DataFrame, num: int, den: int, within: DataFrame | None = None) -> DataFrame:
    """(a, b, groups): pairs that may link points of one bucket that are in different components, and the groups that gave them.

    Of buckets in one piece, those that their forests left open; as near copies share most of many buckets, buckets whose
    members have the same least hash are one group, and send a point once. A slice leaves out pairs whose components its pairs have
    joined: if all pairs that a group gives link, nothing of it is missing. Within some groups, all such pairs.
    Slices are searched in rounds, each of which sends every point ROUND times on average, so disk does not follow their number.
    """
    least = F.array_min(F.transform("members", lambda m: F.xxhash64(m)))
    lists = open_.select(least.alias("group"), "members").unionByName(buckets.filter("large").select(F.col("sig").alias("group"), "members"))
    lists = lists if within is None else lists.join(within, "group", "left_semi")
    rows = lists.select("group", F.explode("members").alias("id")).distinct()
    labelled = staged(rows.join(labels, "id", "left").select("group", "id", F.coalesce("component", "id").alias("component")), "labelled")
    per = labelled.groupBy("group", "component").count()
    main = per.groupBy("group").agg(F.sum("count").alias("size"), F.max(F.struct("count", F.col("component").alias("main"))).alias("top"), F.count("*").alias("parts")).filter("parts > 1")
    blocks = lambda n: F.ceil(n / SLICE).cast("int")
    main = staged(main.select("group", F.col("top.main").alias("main"), F.col("size") - F.col("top.count"), "top.count").toDF("group", "main", "others", "own").withColumns({"blocks": blocks(F.col("others")), "mains": blocks(F.col("own"))}), "apart")
    sent = main.agg(F.sum(F.col("others") * (F.col("blocks") + F.col("mains") - 1) + F.col("own") * F.col("blocks"))).first()[0] or 0
    rounds = int(sent // (ROUND * max(points.count(), 1))) + 1
    dealt = _slices(labelled, main.select("group", "main", "blocks", "mains"))
    every = within is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int, int]] = set()
            for k in range(batch.num_rows):
                group, inner, p = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].values
                ids, n, part = (p.field(c).to_numpy() for c in ("id", "n", "component"))
                asking, bits = p.field("asks").to_numpy(zero_copy_only=False), Digests(p.field("digests"), n)
                counts, (_, part) = bits.coarse(), np.unique(part, return_inverse=True)
                there = np.arange(len(n)) if inner else np.flatnonzero(~asking)
                tree = CountTree(n[there], counts[there])
                for q in np.flatnonzero(asking):
                    near = there[tree.near(n[q], counts[q], num, den)[0]]
                    near = near[(part[near] != part[q]) & ((near > q) | ~asking[near])]
                    near = near[bits.overlap(q, near) * (den + num) >= num * (n[near] + n[q])] if len(near) else near
                    for t in near.tolist():
                        if every or part[t] != part[q]:
                            found.add((int(min(ids[q], ids[t])), int(max(ids[q], ids[t])), group))
                        if not every:
                            part[part == part[t]] = part[q]
            table = np.array(sorted(found), np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(table[:, c]) for c in range(3)], ["a", "b", "group"])

    searched = []
    for r in range(rounds):
        rows = dealt.filter(F.pmod(F.xxhash64("group", "i", "j"), F.lit(rounds)) == r).join(points.select("id", "n", "digests"), "id")
        slices_ = rows.groupBy("group", "i", "j", "inner").agg(F.collect_list(F.struct("id", "n", "digests", "component", "asks")).alias("p"))
        searched.append(staged(map_arrow(slices_.select("group", "inner", "p"), run, "a long, b long, group long"), "searched"))
    cross = staged(reduce(DataFrame.unionByName, searched).groupBy("a", "b").agg(F.collect_set("group").alias("groups")), "cross")
    discard(labelled, main, *searched)
    return cross


def _resolved(df: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> tuple[DataFrame, int]:
    """(id, p, n_shingles, component_id, keeper) of every row, and the seed of p, the row's number.

    keeper is the number of the row that stands for the component: of the least id, null last, then of the least number.
    """
    names = ["h1", "h2", "n_shingles"]
    for seed in range(64):
        texts = _numbered(df, id_col, text_col, seed)
        sets = _sets(texts, width)
        of = F.struct("id", *names)
        numbers = sets.groupBy("p").agg(F.count("*").alias("n"), F.min(of).alias("x"), F.max(of).alias("y"))
        check = numbers.agg(F.max("n").alias("most"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("shared")).first()
        if not check["shared"]:
            break
        discard(sets)  # two rows that differ have one number, which is so rare that numbering anew costs nothing
    if (check["most"] or 0) > 1:
        texts = texts.dropDuplicates(["p"])
    first = F.struct(F.col("id").isNull().alias("none"), "id", "p")
    groups = staged(sets.filter("n_shingles > 0").groupBy(*names).agg(F.min(first).alias("first")).select(*names, F.col("first.id").alias("least"), F.col("first.p").alias("point")), "groups")
    # The texts of other rows of a set are left out by a list that Spark broadcasts while it is short.
    copies = staged(sets.filter("n_shingles > 0").join(groups, names).filter("p <> point").select("p").distinct(), "copies")
    buckets = _buckets(_signed(texts.join(copies, "p", "left_anti"), width, num, den))
    wanted = staged(buckets.select(F.explode("members").alias("id")).distinct(), "wanted")
    point_sets = _point_sets(texts, wanted, width)
    early = F.pmod("sig", F.lit(FIRST)) == 0
    tried, open_, forest = _forest_pairs(buckets.filter(early), point_sets, num, den)
    links = _verified(tried, point_sets, num, den)
    labels = connected_components(links)
    tried2, open2, forest2 = _forest_pairs(buckets.filter(~early), point_sets, num, den, labels)
    tried2 = tried2.join(tried, ["a", "b"], "left_anti")
    links2 = _verified(tried2, point_sets, num, den)
    tried, open_, every = tried.unionByName(tried2), open_.unionByName(open2).distinct(), links.unionByName(links2)
    discard(labels)
    labels, crossed, within = connected_components(every), [], None
    while True:
        cross = _cross_pairs(buckets, open_, point_sets, labels, num, den, within)
        more = _verified(cross.select("a", "b").join(tried, ["a", "b"], "left_anti"), point_sets, num, den)  # what was tried in vain was no link
        crossed += [cross, more]
        given, linking = cross.count(), more.count()
        if linking:
            every = every.unionByName(more)
            discard(labels)
            labels = connected_components(every)
        if linking == given or within is not None:
            break
        within = cross.join(more, ["a", "b"], "left_anti").select(F.explode("groups").alias("group")).distinct()
        tried = tried.unionByName(cross.select("a", "b"))
    discard(copies, buckets, wanted, point_sets, forest, forest2, links, links2, *crossed)
    linked = staged(labels.join(groups, labels["id"] == groups["point"]).select("component", "least", "point"), "linked")
    first = F.struct(F.col("least").isNull().alias("none"), "least", "point")
    each = linked.groupBy("component").agg(F.min(first).alias("first")).select("component", F.col("first.least").alias("component_id"), F.col("first.point").alias("keeper"))
    named = linked.join(each, "component").select(F.col("point").alias("at"), "component_id", "keeper")
    known = groups.join(named, groups["point"] == named["at"], "left")
    known = staged(known.select(*names, F.when(F.col("at").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("keeper", "point").alias("keeper")), "named")
    discard(groups, labels, linked)
    # Staged on both sides, so that Spark can split the rows of a very large group of copies.
    found = sets.join(known, names, "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")))
    return found.select("id", "p", "n_shingles", "component_id", "keeper"), seed


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) of every row: the least id reachable by links of similarity num / den or more.

    Null and empty texts have no n-grams and link with nothing; a text of fewer words than width is one n-gram. Rows of
    one id but different texts are separate documents; a null id has the component of what its text links with, null if
    that is nothing. An empty table gives an empty result; other columns play no part.
    """
    return _resolved(df, id_col, text_col, width, num, den)[0].select("id", "n_shingles", "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """df with one document of each component, the one of the least id, a null one last; all its columns.

    Texts without words stay. Rows of one id with different texts are different documents, rows alike in both are one,
    and stay or go together.
    """
    found, seed = _resolved(df, id_col, text_col, width, num, den)
    loses = staged(found.filter(F.col("p") != F.col("keeper")).select("p").distinct(), "losers")
    number = fresh(df, "p")
    return df.withColumn(number, _number(id_col, text_col, seed)).join(loses.withColumnRenamed("p", f"{number}_"), F.col(number) == F.col(f"{number}_"), "left_anti").select(df.columns)

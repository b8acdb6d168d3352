"""Quality of documents: histogram gradient-boosted trees over statistics of the text.

Statistics are taken of whole texts, a batch at a time in numpy. Trees are grown on binned features of a bounded sample of
labelled rows and flattened into arrays; scoring walks all rows of a batch down a tree level by level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_column, crc_mod, hash_sample, map_arrow, slices, span_hash, staged, utf8, words

#: Labelled rows that the trees are grown on, at most: those of least hash.
MAX_LABELS = 30_000
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 80, 5, 64, 0.15, 20, 1.0

_CLASSES = 12
_CLASS = np.full(256, 9, np.uint8)  # other signs
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[32, 9, 11, 12, 13]] = 3
_CLASS[10] = 4
_CLASS[[ord("."), ord(","), ord(";"), ord(":"), ord("'")]] = 5
_CLASS[[ord("!"), ord("?")]] = 6
_CLASS[[ord("|"), ord("<"), ord(">"), ord("{"), ord("}"), ord("\\"), ord("=")]] = 7
_CLASS[128:192] = 8
_CLASS[192:] = 10
_CLASS[:9] = 11
_CLASS[14:32] = 11
FEATURES = _CLASSES + 14


def _distinct(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """How many different values each text has."""
    if not len(doc):
        return np.zeros(n)
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20)))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return np.bincount((key[first] >> np.uint64(44)).astype(np.int64), minlength=n).astype(float)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of FEATURES numbers for each text; an empty text has zeros throughout."""
    buf, offsets = utf8(column)
    n, size = len(offsets) - 1, np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc * _CLASSES + _CLASS[buf[: offsets[-1]]], minlength=n * _CLASSES).reshape(n, _CLASSES).astype(float)
    low = buf.copy()
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    start, length, count = words(buf, offsets)
    owner = np.repeat(np.arange(n), count)
    some = np.maximum(count, 1)
    total = lambda x: np.bincount(owner, weights=x, minlength=n) / some
    h = span_hash(low, start, length)
    together = np.zeros(len(h), bool)
    together[1:] = owner[1:] == owner[:-1]
    again = np.zeros(len(h), bool)
    again[1:] = together[1:] & (h[1:] == h[:-1])
    pair = h[1:] * np.uint64(0x9E3779B97F4A7C15) ^ h[:-1]
    tail = _CLASS[buf[start + length - 1]] if len(start) else np.zeros(0, np.uint8)
    head = _CLASS[buf[start]] if len(start) else np.zeros(0, np.uint8)
    mean = total(length)
    shares = kinds / np.maximum(size, 1)[:, None]
    letters = kinds[:, 0] + kinds[:, 1]
    return np.column_stack([
        shares, np.log1p(size), np.log1p(count), mean, np.sqrt(np.maximum(total(length.astype(float) ** 2) - mean**2, 0)),
        total(length > 20), total(length == 1), total(again), _distinct(owner, h, n) / some,
        _distinct(owner[1:][together[1:]], pair[together[1:]], n) / np.maximum(count - 1, 1),
        total((tail == 9) | (tail == 6) | (tail == 7)), total((head == 9) | (head == 7)), kinds[:, 1] / np.maximum(letters, 1),
        size / (kinds[:, 4] + 1) / 1000, kinds[:, 5] / some,
    ]).astype(np.float32)


@dataclass
class Trees:
    """Flat arrays over the nodes of all trees: a leaf leads to itself."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the logistic loss. Without rows the score is 0.5; with one class, its smoothed share."""
    n, f = x.shape
    share = (y.sum() + 0.5) / (n + 1.0)
    start = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])).astype(np.float32) for j in range(f)]
        binned = np.column_stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(f)])
        margin = np.full(n, start)
        flat = binned + np.arange(f) * BINS
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            at = np.zeros(n, np.int64)
            first = len(nodes)
            roots.append(first)
            nodes.append([0, np.inf, first, first, 0.0])
            level = {0: first}
            leaf = np.full(n, first)
            for depth in range(DEPTH + 1):
                m = len(level)
                sums = [np.bincount(at, weights=v, minlength=m) for v in (g, h)]
                for k, node in level.items():
                    nodes[node][4] = RATE * sums[0][k] / (sums[1][k] + RIDGE)
                if depth == DEPTH:
                    break
                cell = (at[:, None] * (f * BINS) + flat).ravel()
                hg, hh, hc = (np.bincount(cell, weights=np.repeat(v, f), minlength=m * f * BINS).reshape(m, f, BINS).cumsum(2) for v in (g, h, np.ones(n)))
                tg, th, tc = hg[:, :, -1:], hh[:, :, -1:], hc[:, :, -1:]
                gain = hg**2 / (hh + RIDGE) + (tg - hg) ** 2 / (th - hh + RIDGE) - tg**2 / (th + RIDGE)
                gain[(hc < LEAST) | (tc - hc < LEAST)] = -1
                best = gain.reshape(m, -1).argmax(1)
                following: dict[int, int] = {}
                renamed = np.full((m, 2), -1)
                cut_feature, cut_bin = best // BINS, best % BINS
                for k, node in level.items():
                    j, b = int(cut_feature[k]), int(cut_bin[k])
                    if gain[k, j, b] <= 1e-6 or b >= len(edges[j]):
                        continue
                    for side in (0, 1):
                        child = len(nodes)
                        nodes.append([0, np.inf, child, child, 0.0])
                        renamed[k, side] = len(following)
                        following[len(following)] = child
                        nodes[node][2 + side] = child
                    nodes[node][0], nodes[node][1] = j, float(edges[j][b])
                side = (binned[np.arange(n), cut_feature[at]] > cut_bin[at]).astype(int)
                to = renamed[at, side]
                keep = to >= 0
                if not following:
                    break
                # Rows whose node stays a leaf take part no more in this tree.
                leaf_rows = ~keep
                at = np.where(keep, to, 0)
                if leaf_rows.any():
                    g, h = np.where(keep, g, 0), np.where(keep, h, 0)
                leaf = np.where(keep, np.array([following[i] for i in range(len(following))])[at], leaf)
                level = following
            margin += np.array([node[4] for node in nodes[first:]])[leaf - first]
    table = np.array(nodes, float).reshape(-1, 5)
    return Trees(table[:, 0].astype(int), table[:, 1].astype(np.float32), table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], np.array(roots, int), start)


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df without its text, with statistics (in place of a column of that name): FEATURES numbers of each whole text; staged."""
    df = df.drop("statistics")

    def run(texts: pa.Array) -> pa.Array:
        return pa.FixedSizeListArray.from_arrays(pa.array(_in_parts(texts, statistics).ravel()), FEATURES).cast(pa.list_(pa.float32()))

    return staged(df.withColumn("statistics", arrow_column(df, run, "array<float>", text_col)).drop(text_col), "statistics")


def _in_parts(texts: pa.Array, function: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """function of a few MB of texts at a time."""
    parts = [function(b.column(0)) for b in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text", 1_000_000)]
    return np.concatenate(parts) if parts else function(texts)


def label_sample(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_labels: int = MAX_LABELS) -> DataFrame:
    """(__id, __y): the labels learned from, all but those whose crc32 of the id leaves 2 modulo 4, max_labels at most.

    An id that is labelled more than once counts once, by its greatest label; null ids and other labels than 0 and 1 do not count.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (crc_mod(id_col, 4) != 2)).select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y"))
    return hash_sample(usable.groupBy("__id").agg(F.max("__y").alias("__y")), "__id", max_labels)


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_labels: int = MAX_LABELS) -> Trees:
    """Grow trees on the measured rows that the sample of labels names; of several rows of one id, the one of the greatest statistics."""
    sample = label_sample(labels, id_col, label_col, max_labels)  # bounded, so it may be broadcast
    rows = stats.select(F.col(id_col).alias("__doc"), "statistics").join(F.broadcast(sample), F.col("__doc") == F.col("__id")).groupBy("__id").agg(F.max(F.struct("statistics", "__y")).alias("r")).select("r.*").toArrow()
    x = rows.column("statistics").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
    y = rows.column("__y").to_numpy().astype(float)
    order = np.lexsort([y, *x.T])  # the rows' order differs from run to run
    return grow(x[order], y[order])


def scores(stats: DataFrame, trees: Trees) -> DataFrame:
    """Measured rows with score, the chance of label 1, in place of statistics and of a column of that name."""
    stats = stats.drop("score")
    names = [c for c in stats.columns if c != "statistics"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("statistics"))
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(trees.score(x))], [*names, "score"])

    return map_arrow(stats, run, T.StructType([*[f for f in stats.schema.fields if f.name in names], T.StructField("score", T.DoubleType())]))


def scored(df: DataFrame, trees: Trees, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """df, texts included, with out_col, which displaces a column of that name; null and empty texts are scored like any other."""
    df = df.drop(out_col)
    held = df.sparkSession.sparkContext.broadcast(trees)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(_in_parts(texts, lambda part: held.value.score(statistics(part))))

    return df.withColumn(out_col, arrow_column(df, run, "double", text_col))

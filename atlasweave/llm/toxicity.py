"""Toxicity: a linear classifier over hashed character n-grams, scaled by naive Bayes log-count ratios.

N-grams lie within a word and its two ends. Spark counts, over the labelled sample, in how many texts of each class an
n-gram occurs; the ratios pick and scale the features, and logistic regression weighs them. A text's score depends on
which n-grams occur in the whole of it, not on how often.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, hash_sample, map_arrow, slices, staged, utf8

#: Labelled texts learned from, at most: those of least hash.
MAX_LABELS = 20_000
BITS = 21
LENGTHS = (4, 6, 8)
#: Features kept, of those in LEAST texts or more: the ones whose ratios are surest.
FEATURES, LEAST = 1 << 14, 4
ROUNDS, RIDGE = 150, 1.0


def ngrams(column: pa.Array, wanted: np.ndarray | None = None, lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) pairs, each once, in order; only buckets that wanted has, if given."""
    buf, offsets = utf8(column)
    n = int(offsets[-1])
    # Each text gets a space at its end, so that its last word ends there; letters lose their case, other signs part words.
    size = np.diff(offsets)
    at = np.arange(n) + np.repeat(np.arange(len(size)), size) + 1
    line = np.full(n + len(size) + 8, 32, np.uint8)
    body = buf[:n]
    letter = ((body >= 97) & (body <= 122)) | (body >= 128)
    upper = (body >= 65) & (body <= 90)
    line[at] = np.where(upper, body + 32, np.where(letter, body, 32))
    starts = offsets[:-1] + np.arange(len(size))
    gap = line == 32
    h = line[: n + len(size)].astype(np.uint64)
    inner = np.zeros(n + len(size), bool)  # a space inside the n-gram
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(1, max(lengths)):
        if k > 1:
            inner |= gap[k - 1 : n + len(size) + k - 1]
        h = h * np.uint64(0x100000001B3) + line[k : n + len(size) + k].astype(np.uint64) + np.uint64(1)
        if k + 1 in lengths:
            good = np.flatnonzero(~inner)
            bucket = ((h[good] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
            if wanted is not None:
                hit = wanted[bucket]
                good, bucket = good[hit], bucket[hit]
            found.append((good, bucket))
    place = np.concatenate([a for a, _ in found])
    bucket = np.concatenate([b for _, b in found])
    owner = np.searchsorted(starts, place, "right") - 1
    pairs = np.unique((owner << BITS) | bucket)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass
class Linear:
    """Weights over 2 ** BITS buckets, zero for those not kept: fixed in size."""

    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        text, bucket = ngrams(column, self.weights != 0)
        return 1 / (1 + np.exp(-(self.bias + np.bincount(text, weights=self.weights[bucket], minlength=len(column)))))


def _counts(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int32)
        for batch in slices(batches, "text", 1_000_000):  # all n-grams of a slice are held at once
            text, bucket = ngrams(batch.column(batch.schema.get_field_index("text")))
            y = batch.column(batch.schema.get_field_index("y")).to_numpy()
            for k in (0, 1):
                counts[k] += np.bincount(bucket[y[text] == k], minlength=1 << BITS).astype(np.int32)
        some = np.flatnonzero(counts.any(0))
        for i in range(0, len(some), 100_000):
            part = some[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[0][part].astype(np.int64)), pa.array(counts[1][part].astype(np.int64))], ["bucket", "no", "yes"])

    return map_arrow(sample, run, "bucket long, no long, yes long").groupBy("bucket").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labels: int = MAX_LABELS) -> Linear:
    """Learn from labelled rows, all but those whose crc32 of the id leaves 0 modulo 5. With no or one class: a constant.

    An id that is labelled more than once has its greatest label; each text of such an id counts.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (crc_mod(id_col, 5) != 0)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y"))
    chosen = hash_sample(usable.groupBy("__id").agg(F.max("y").alias("y")), "__id", max_labels)  # bounded, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text"))
    sample = staged(rows.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("text", "y"), "toxic-sample")
    size = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    no, yes = size.get(0, 0), size.get(1, 0)
    weights, prior = np.zeros(1 << BITS, np.float32), float(np.log((yes + 0.5) / (no + 0.5)))
    if not no or not yes:
        return Linear(weights, prior)
    counted = _counts(sample).filter(F.col("no") + F.col("yes") >= LEAST)
    ratio = F.log((F.col("yes") + 1) / (yes + 2.0)) - F.log((F.col("no") + 1) / (no + 2.0))
    spread = F.sqrt(1 / (F.col("yes") + 1) + 1 / (F.col("no") + 1))
    kept = counted.select("bucket", ratio.alias("ratio"), (F.abs(ratio) / spread).alias("sure")).orderBy(F.desc("sure"), "bucket").limit(FEATURES).toArrow()
    ratios = np.zeros(1 << BITS)
    ratios[kept.column("bucket").to_numpy()] = kept.column("ratio").to_numpy()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = ratios != 0
        for batch in slices(batches, "text", 2_000_000):
            text, bucket = ngrams(batch.column(batch.schema.get_field_index("text")), wanted)
            ends = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("y")), pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))], ["y", "x"])

    table = map_arrow(sample, features, "y int, x array<int>").toArrow()
    x = table.column("x").combine_chunks()
    flat, ends, y = x.flatten().to_numpy(zero_copy_only=False), np.asarray(x.offsets), table.column("y").to_numpy()
    rows = sorted((flat[a:b].tobytes(), int(k)) for a, b, k in zip(ends[:-1], ends[1:], y, strict=True))  # they come in any order
    sizes = [len(x) // 4 for x, _ in rows]
    return _regress(np.frombuffer(b"".join(x for x, _ in rows), np.int32), np.cumsum([0, *sizes]), np.array([k for _, k in rows], float), ratios, prior)


def _regress(index: np.ndarray, offsets: np.ndarray, y: np.ndarray, ratios: np.ndarray, prior: float) -> Linear:
    """Logistic regression with a ridge on features of value ratio, by adaptive gradient steps."""
    used, local = np.unique(index, return_inverse=True)
    value = ratios[used]
    row = np.repeat(np.arange(len(y)), np.diff(offsets))
    w, bias = np.zeros(len(used)), prior
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, ROUNDS + 1):
        p = 1 / (1 + np.exp(-(bias + np.bincount(row, weights=(w * value)[local], minlength=len(y)))))
        g = p - y
        grad = np.append(np.bincount(local, weights=g[row], minlength=len(used)) * value + RIDGE * w, g.sum()) / len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w * value
    return Linear(weights, float(bias))


def scored(df: DataFrame, model: Linear, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """df with score (in place of a column of that name), the chance of label 1, by its whole text; null and empty texts get the bias alone."""
    df = df.drop("score")
    kept = [f for f in df.schema.fields if keep_text or f.name != text_col]
    names = [f.name for f in kept]
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 2_000_000):
            score = held.value.score(batch.column(batch.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(score)], [*names, "score"])

    return map_arrow(df, run, T.StructType([*kept, T.StructField("score", T.DoubleType())]))

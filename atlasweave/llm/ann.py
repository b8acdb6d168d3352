"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are taken relative to the nearest of a few centroids, rotated at random and kept as sign bits with two numbers:
the length of the residual and its inner product with its own code. From these an inner product with a query is estimated
with an error bound: a query has a table of partial sums for each byte of a code, and the packed bytes look them up. Vectors
whose least possible distance is within the best so far are ranked again on the original vectors. Queries come in blocks of
bounded size, each sent to all tasks; a task leaves out the codes of a centroid for queries that the triangle inequality
keeps farther from them than what they have found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hash_sample, map_arrow, staged

#: Vectors that the centroids are fitted on, at most: those of least hash.
SAMPLE = 8192
CENTROIDS = 16
#: Queries in a block, about; codes and queries compared at once.
QUERY_BLOCK, TILE, QUERY_TILE = 4096, 2048, 512
#: Width of the error bound in standard deviations of the estimate.
WIDTH = 3.5


@dataclass
class Rotation:
    centroids: np.ndarray
    matrix: np.ndarray

    @property
    def dim(self) -> int:
        return self.matrix.shape[0]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Centroid, packed sign bits, length and code product of the residual of each row."""
        near = np.argmin(((x**2).sum(1)[:, None] - 2 * x @ self.centroids.T) + (self.centroids**2).sum(1), axis=1)
        r = (x - self.centroids[near]) @ self.matrix.T
        length = np.sqrt((r**2).sum(1))
        fit = np.abs(r).sum(1) / np.sqrt(self.dim) / np.where(length > 0, length, 1)
        return near, np.packbits(r > 0, axis=1), length, np.where(length > 0, fit, 1.0)


def fit(sample: np.ndarray, dim: int, seed: int = 0) -> Rotation:
    """Centroids by a few rounds of k-means on the sample, and a random rotation."""
    rng = np.random.default_rng(seed)
    matrix, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
    if not len(sample):
        return Rotation(np.zeros((1, dim)), matrix)
    centroids = sample[rng.choice(len(sample), min(CENTROIDS, len(sample)), replace=False)].copy()
    for _ in range(8):
        near = np.argmin(-2 * sample @ centroids.T + (centroids**2).sum(1), axis=1)
        for k in range(len(centroids)):
            if (near == k).any():
                centroids[k] = sample[near == k].mean(0)
    return Rotation(centroids, matrix)


def usable(vec: str | Column, dim: int) -> Column:
    """Whether a vector takes part: of the common size, not zero, without null or non-finite components."""
    v = F.col(vec) if isinstance(vec, str) else vec
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(v) == dim) & ~F.exists(v, odd) & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, summed component after component."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        d = a[:, j] - b[:, j]
        total += d * d
    return np.sqrt(total)


class Best:
    """The k nearest of each query so far, nearest first, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        some = np.unique(query)
        local = np.searchsorted(some, query)
        q = np.concatenate([np.repeat(np.arange(len(some)), self.k), local])
        s, i = np.concatenate([self.score[some].ravel(), score]), np.concatenate([self.id[some].ravel(), ids])
        order = np.lexsort((i, s, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = order[rank < self.k]
        self.score[some], self.id[some] = s[top].reshape(-1, self.k), i[top].reshape(-1, self.k)


def _search(batch: pa.RecordBatch, model: Rotation, queries: np.ndarray, query_ids: np.ndarray, best: Best) -> None:
    dim, root = model.dim, np.sqrt(model.dim)
    get = lambda c: batch.column(batch.schema.get_field_index(c))
    ids, vectors = get("id").to_numpy(zero_copy_only=False), _matrix(get("vec"), dim)
    near, length, fit_ = (get(c).to_numpy(zero_copy_only=False) for c in ("near", "length", "fit"))
    codes = np.frombuffer(b"".join(get("code").to_pylist()), np.uint8).reshape(len(ids), -1)
    for c in np.unique(near):
        rows = np.flatnonzero(near == c)
        rows = rows[np.argsort(length[rows], kind="stable")]  # a tile's residuals are alike in length, so that its bound is tight
        rotated = (queries - model.centroids[c]) @ model.matrix.T
        far = np.sqrt((rotated**2).sum(1))
        for i in range(0, len(rows), TILE):
            tile = rows[i : i + TILE]
            away = np.maximum(far - length[tile].max(), length[tile].min() - far)
            live = np.flatnonzero(away <= best.score[:, -1] * (1 + 1e-6) + 1e-9)
            slack = np.sqrt(np.maximum(1 - fit_[tile] ** 2, 0)) / fit_[tile] * WIDTH / np.sqrt(max(dim - 1, 1))
            for j in range(0, len(live), QUERY_TILE):
                part = live[j : j + QUERY_TILE]
                inner = code_products(codes[tile], rotated[part]) / (root * fit_[tile])[:, None]
                plain = (length[tile] ** 2)[:, None] + far[part] ** 2
                own = ids[tile][:, None] == query_ids[part]
                estimate = np.where(own, np.inf, plain - 2 * length[tile][:, None] * inner)
                k = min(best.k, len(tile))
                first = np.argpartition(estimate, k - 1, axis=0)[:k]
                seen = np.zeros(estimate.shape, bool)
                for step in (0, 1):
                    if step:
                        reach = best.score[part, -1] ** 2
                        bound = estimate - 2 * length[tile][:, None] * slack[:, None] * far[part]
                        wanted = (bound <= reach * (1 + 1e-6) + 1e-9) & ~seen & ~own
                    else:
                        wanted = np.zeros(estimate.shape, bool)
                        np.put_along_axis(wanted, first, True, axis=0)
                        wanted &= ~own
                        seen = wanted
                    a, b = np.nonzero(wanted)
                    for s in range(0, len(a), 100_000):
                        x, y = a[s : s + 100_000], part[b[s : s + 100_000]]
                        best.add(y, distances(vectors[tile[x]], queries[y]), ids[tile[x]])


#: The signs that each byte's bits stand for.
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1


def code_products(codes: np.ndarray, rotated: np.ndarray) -> np.ndarray:
    """Inner products of codes (rows of packed sign bits) with rotated queries: a sum of one looked-up number for each byte."""
    width = codes.shape[1]
    padded = np.zeros((width * 8, len(rotated)), np.float32)
    padded[: rotated.shape[1]] = rotated.T
    total = np.zeros((len(codes), len(rotated)), np.float32)
    for byte in range(width):
        table = _SIGNS @ padded[byte * 8 : byte * 8 + 8]  # the products of all 256 bytes with eight coordinates of each query
        total += table[codes[:, byte]]
    return total


def index(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, Rotation]:
    """Codes of all vectors that take part, staged, and the rotation they were made with.

    The common size is the most frequent one, the smaller of equals. Rows without id take no part.
    """
    sizes = df.filter(F.size(vec_col) > 0).groupBy(F.size(vec_col).alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = sizes[0]["dim"] if sizes else 1
    rows = df.filter(F.col(id_col).isNotNull() & usable(vec_col, dim)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    sample = hash_sample(rows, "id", SAMPLE).select("vec").toArrow().column("vec").combine_chunks()
    x = _matrix(sample, dim) if len(sample) else np.zeros((0, dim))
    model = fit(x[np.lexsort(x.T)], dim)  # rows come in any order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, code, length, fits = model.encode(_matrix(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array([x.tobytes() for x in code], pa.binary()), pa.array(length), pa.array(fits)], ["id", "vec", "near", "code", "length", "fit"])

    item = rows.schema["vec"].dataType.simpleString()
    return staged(map_arrow(rows, run, f"id long, vec {item}, near int, code binary, length double, fit double"), "codes"), model


def search(codes: DataFrame, model: Rotation, queries: DataFrame, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest vectors of each query (id, vec), itself left out.

    All candidates if fewer than k. A query id that repeats counts once, by its least vector; repeated candidates count each.
    """
    spark = codes.sparkSession
    once = staged(queries.groupBy("id").agg(F.min("vec").alias("vec")), "queries")
    blocks = -(-once.count() // block)
    found = None
    for number in range(max(blocks, 1)):
        mine = once.filter(F.pmod(F.xxhash64("id"), F.lit(max(blocks, 1))) == number).orderBy("id").toArrow()  # a block, bounded
        vectors = _matrix(mine.column("vec").combine_chunks(), model.dim) if mine.num_rows else np.zeros((0, model.dim))
        held = spark.sparkContext.broadcast((model, vectors, mine.column("id").to_numpy().astype(np.int64)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            model, vectors, ids = held.value
            best = Best(len(ids), k)
            for batch in batches:
                if batch.num_rows and len(ids):
                    _search(batch, model, vectors, ids, best)
            q, r = np.nonzero(np.isfinite(best.score))
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best.id[q, r]), pa.array(best.score[q, r])], ["query_id", "vec_id", "score"])

        part = map_arrow(codes, run, "query_id long, vec_id long, score double")
        part = staged(part, "found") if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """search() over df for the rows whose id is divisible by every."""
    codes, model = index(df, id_col, vec_col)
    return search(codes, model, codes.filter(F.col("id") % every == 0).select("id", "vec"), k)

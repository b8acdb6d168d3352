"""Helpers shared by the corpus operators: staged tables and hashing of byte ranges in numpy."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

#: Where stages go when a session on one machine names no folder.
LOCAL_STAGE = "/tmp/checkpoints"
#: Bytes in a batch that goes to Python, about, unless the session sets its own limit.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Set while a stage is written: its shuffle files go as soon as it is written, not when the driver happens to collect its garbage.
_CLEAN_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MULT2 = np.uint64(0xBF58476D1CE4E5B9)


def stage_path(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. A cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = LOCAL_STAGE
    return f"{base.rstrip('/')}/stage-{label}-{uuid.uuid4().hex}"


@contextmanager
def _session(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session with these settings, which are then what they were."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def staged(df: DataFrame, label: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Write df, under some settings, to the shared folder and read it again: lineage is cut and lost executors cost no recomputation.

    The shuffle files of the write are deleted at its end, so stages take the disk of one of them and not of all.
    """
    path = stage_path(df.sparkSession, label)
    with _session(df.sparkSession, {_CLEAN_CONF: "true", **(settings or {})}):
        df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stage_path = path
    return found


def discard(*frames: DataFrame) -> None:
    """Delete the folders of staged tables that nothing will read again."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stage_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _prepare(spark: SparkSession) -> None:
    """Send the package to the executors, and keep batches small: a worker then holds a few MB beside its longest text."""
    ship(spark)
    if not spark.conf.get(_BATCH_CONF, None):
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def map_arrow(df: DataFrame, function: Callable, schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow with a function of this package; what Arrow holds in reserve is given back when a task ends."""
    _prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def arrow_column(df: DataFrame, function: Callable[[pa.Array], pa.Array], kind: str, column: str) -> Column:
    """A column that function makes of another: only that one goes to Python, and only the result comes back."""
    _prepare(df.sparkSession)

    def run(values: pa.Array) -> pa.Array:
        return function(values)

    return F.arrow_udf(run, kind)(F.col(column))


def hash_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """All rows of df, or if there are more than bound, about bound of them by least hash of a key: no task sees them all."""
    n = df.count()
    share = int(0.97 * bound / max(n, 1) * (1 << 31))
    return (df if n <= bound else df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 31)) < share)).limit(bound)


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo modulus; null for a null id."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % modulus


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, with 8 bytes of padding, and the n + 1 offsets of its values."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = arr.cast(pa.large_binary() if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else pa.large_string())
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_large_binary(arr.type) else "")
    if not len(arr):
        return np.zeros(8, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.concatenate([raw, np.zeros(8, np.uint8)]), offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that column holds about limit bytes in each; a longer value comes alone."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        _, offsets = utf8(batch.column(at)) if batch.num_rows > 1 else (None, np.array([0, 0]))
        start = 0
        while start < batch.num_rows:
            stop = batch.num_rows if len(offsets) == 2 else max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _MULT2
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_view(buf: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit word at each byte of a padded buffer."""
    return np.ndarray(shape=(max(len(buf) - 7, 0),), dtype="<u8", buffer=buf, strides=(1,))


def span_hash(buf: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range of a padded buffer."""
    view = word_view(buf)
    h = mix(length.astype(np.uint64) * _MULT + np.uint64(seed))
    live = None
    for k in range(int(length.max() + 7) // 8 if len(length) else 0):
        if k:
            live = np.flatnonzero(length > 8 * k)
            word = view[start[live] + 8 * k] & _MASK[np.minimum(length[live] - 8 * k, 8)]
            h[live] = mix((h[live] ^ word) * _MULT)
        else:
            h = mix((h ^ (view[start] & _MASK[np.minimum(length, 8)])) * _MULT)
    return h


def same_spans(buf: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, other: np.ndarray) -> bool:
    """Whether each range at a equals the range at b."""
    if not np.array_equal(length, other):
        return False
    view = word_view(buf)
    for k in range(int(length.max() + 7) // 8 if len(length) else 0):
        live = np.flatnonzero(length > 8 * k) if k else slice(None)
        if np.any((view[a[live] + 8 * k] ^ view[b[live] + 8 * k]) & _MASK[np.minimum(length[live] - 8 * k, 8)]):
            return False
    return True


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs outside space and \\x09-\\x0D in each text: start, length, and the number of words of each text."""
    n = int(offsets[-1])
    solid = np.ones(n + 2, bool)
    body = buf[:n]
    solid[1:-1] = ~((body == 32) | ((body >= 9) & (body <= 13)))
    solid[0] = solid[-1] = False
    left = solid[:-1].copy()
    left[offsets] = False  # a text's first byte begins a word whatever ends the text before
    begins = np.flatnonzero(solid[1:-1] & ~left[:n]) if n else np.zeros(0, np.int64)
    right = solid[2:].copy() if n else np.zeros(0, bool)
    edge = offsets[1:] - 1
    right[edge[(edge >= 0) & (edge < n)]] = False
    ends = np.flatnonzero(solid[1:-1] & ~right) + 1 if n else np.zeros(0, np.int64)
    per_text = np.diff(np.searchsorted(begins, offsets))
    return begins, ends - begins, per_text

"""Exact de-duplication by a distributed content sort.

Sampled splitters deal rows out by range of their normalised bytes, an external sort places equal texts side by side,
and each row is compared in full with its neighbour. The key that is sampled and sorted is short (the first bytes of the
normalised text, then its SHA-256), so that splitters stay small however long the texts are; the id is the last part of
the key, so that a group of copies may span many partitions. Runs that touch a partition's edge are joined to their
neighbours afterwards, two at most for each partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import map_arrow, staged

#: Bytes of the normalised text that lead the sort key.
PREFIX = 16
_KEY = "__sort_key"
_RUN = T.StructType(
    [
        T.StructField("__part", T.LongType()),
        T.StructField("__run", T.LongType()),
        T.StructField("__max", T.LongType()),
        T.StructField("__size", T.LongType()),
        T.StructField("__last", T.BooleanType()),
        T.StructField("__edge", T.BooleanType()),
        T.StructField("__edge_text", T.StringType()),
        T.StructField("text_sha256", T.StringType()),
    ]
)


def normalise(column: pa.Array) -> pa.Array:
    """A-Z in lower case and nothing else; null as empty."""
    return pc.ascii_lower(column.fill_null("") if column.null_count else column)


def _keyed(df: DataFrame, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = normalise(batch.column(batch.schema.get_field_index(text_col)))
            keys = [(raw := x.as_buffer().to_pybytes())[:PREFIX].ljust(PREFIX, b"\0") + hashlib.sha256(raw).digest() for x in norm]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, _KEY])

    return map_arrow(df, run, T.StructType([*df.schema.fields, T.StructField(_KEY, T.BinaryType())]))


def _runs(df: DataFrame, id_col: str, text_col: str, keep_only: bool) -> DataFrame:
    """Sort by content and number the runs of equal texts in each partition; staged, as two readers must see one numbering."""
    kept = [f for f in df.schema.fields if keep_only or f.name != text_col]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *_RUN.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        pending: list[pa.Table] = []  # the rows of the run that may go on: all without texts, or just the latest
        before: str | None = None
        number, size, most, sha = 0, 0, None, ""

        def close(edge: bool) -> pa.Table:
            rows = pa.concat_tables(pending)
            n = rows.num_rows
            last = np.zeros(n, bool)
            last[-1] = True
            text = pa.array([before if edge else None] + [None] * (n - 1), pa.string())
            extra = [pa.array([v] * n, t) for v, t in ((part, pa.int64()), (number, pa.int64()), (most, pa.int64()), (size, pa.int64()))]
            extra += [pa.array(last), pa.array([edge] * n), text, pa.array([sha] * n, pa.string())]
            return pa.table([*rows.columns, *extra], [*names, *_RUN.names])

        for batch in batches:
            if not batch.num_rows:
                continue
            norm = normalise(batch.column(batch.schema.get_field_index(text_col)))
            rows = pa.Table.from_batches([batch]).select(names)
            ids = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
            keys = batch.column(batch.schema.get_field_index(_KEY))
            fresh = np.ones(batch.num_rows, bool)
            fresh[1:] = ~pc.equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
            fresh[0] = before is None or norm[0].as_py() != before
            bounds = np.append(np.flatnonzero(fresh), batch.num_rows)
            done: list[pa.Table] = []
            for a, b in zip([0, *bounds[:-1].tolist()] if bounds[0] else bounds[:-1].tolist(), bounds.tolist() if bounds[0] else bounds[1:].tolist(), strict=True):
                if fresh[a]:
                    if pending:
                        done.append(close(edge=number == 0))
                        number += 1
                    pending, size, most = [], 0, None
                    before, sha = norm[a].as_py(), keys[a].as_py()[PREFIX:].hex()
                size += b - a
                most = max((i for i in (most, ids[b - 1]) if i is not None), default=None)  # ids ascend in a run
                pending = [rows.slice(b - 1, 1)] if keep_only else [*pending, rows.slice(a, b - a)]
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
        if pending:
            yield from close(edge=True).combine_chunks().to_batches()

    sorted_rows = _keyed(df, text_col).repartitionByRange(F.col(_KEY), F.col(id_col)).sortWithinPartitions(_KEY, id_col)
    return staged(map_arrow(sorted_rows, run, schema), "content-sort")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_only: bool = False) -> DataFrame:
    """One row per input row: keep_id, group_size, kept and text_sha256 beside its columns; with keep_only, rows of df that stay.

    Equal means identical after lower-casing A-Z; null counts as empty. The largest id of a group stays; null ids yield
    to any other, and of rows alike in id and text one stays. Every other column passes, but for the text and columns named like
    those made here (with keep_only, all columns pass). An empty table gives an empty result.
    """
    made = ("keep_id", "group_size", "kept", "text_sha256")
    names = df.columns
    id_at, text_at = (f"c{names.index(c)}" for c in (id_col, text_col))
    runs = _runs(df.toDF(*[f"c{k}" for k in range(len(names))]), id_at, text_at, keep_only)
    same = Window.partitionBy("__edge_text")
    edges = (
        runs.filter(F.col("__edge_text").isNotNull())
        .select("__part", "__run", F.max("__max").over(same).alias("__all_max"), F.sum("__size").over(same).alias("__all_size"), F.max(F.struct("__part", "__run")).over(same).alias("__end"))
    )
    # Two rows of five numbers for each partition; staged, so that Spark knows their size when it chooses the join.
    joined = runs.join(staged(edges, "edges"), ["__part", "__run"], "left")
    keep = F.when(F.col("__edge"), F.col("__all_max")).otherwise(F.col("__max"))
    holds = F.col("__last") & F.when(F.col("__edge"), F.when(keep.isNull(), F.col("__end") == F.struct("__part", "__run")).otherwise(F.col(id_at) == keep)).otherwise(True)
    if keep_only:
        return joined.filter(F.coalesce(holds, F.lit(False))).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])
    return joined.select(
        *[F.col(f"c{k}").alias(c) for k, c in enumerate(names) if c != text_col and c.lower() not in made],
        keep.alias("keep_id"),
        F.when(F.col("__edge"), F.col("__all_size")).otherwise(F.col("__size")).alias("group_size"),
        F.coalesce(holds, F.lit(False)).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group of equal texts, the one of the largest id."""
    return exact_duplicates(df, id_col, text_col, keep_only=True)

"""State kept for users: upserts, first-wins inserts, deletes, defaults and updates as rewrites of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ranked(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def numbered(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """All rows with their position among those of their key, from 1."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def latest(df: DataFrame, keys: list[str], time_col: str, tie: str) -> DataFrame:
    """Upsert: the row of each key that was written last."""
    return _ranked(df, keys, [F.desc(time_col), F.desc(tie)])


def earliest(df: DataFrame, keys: list[str], time_col: str, tie: str) -> DataFrame:
    """Insert or ignore: the row of each key that was written first."""
    return _ranked(df, keys, [F.asc(time_col), F.asc(tie)])


def delete(df: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no request names by key and owner."""
    return df.join(requests.select(*keys).distinct(), keys, "left_anti")


def cascade(df: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is still there."""
    return df.join(parents.select(key).distinct(), key, "left_semi")


def set_null(df: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """All rows; the reference to a parent that is gone becomes null."""
    there = parents.select(F.col(key).alias("__there")).distinct()
    return df.join(there, df[key] == F.col("__there"), "left").withColumn(key, F.col("__there")).drop("__there")


def with_defaults(keys: DataFrame, table: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """A row for each key: the table's as it is, nulls included, or, where there is none, one of defaults."""
    out = keys.select(key).distinct().join(table.withColumn("__there", F.lit(True)), key, "left")
    return out.withColumns({c: F.when(F.col("__there"), F.col(c)).otherwise(F.lit(v)) for c, v in defaults.items()}).drop("__there")


def or_default(column: str, default: object) -> Column:
    """A changed value, or the default where it is null, empty, zero or false."""
    c = F.col(column)
    missing = c.isNull() | c.cast("string").isin("", "0", "0.0", "false")
    return F.when(missing, F.lit(default)).otherwise(c).alias(column)


def completion(done: str, at: Column) -> tuple[Column, Column]:
    """Columns is_completed (false for null) and completed_at: the time given for what is completed, null for what is not."""
    is_done = F.coalesce(F.col(done).cast("boolean"), F.lit(False))
    return is_done.alias("is_completed"), F.when(is_done, at).alias("completed_at")


def update(df: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], order: Column | None = None) -> DataFrame:
    """df with the columns of rows that changes names by key and owner set anew; other rows as they are.

    Of several changes of one key the last by order holds, by its values where no order is given.
    """
    values = F.struct(*[F.col(c).alias(c) for c in columns])
    named = changes.groupBy(*keys).agg(F.max_by(values, values if order is None else order).alias("__new")).withColumn("__hit", F.lit(True))
    out = df.join(named, keys, "left")
    return out.withColumns({c: F.when(F.col("__hit"), F.col("__new")[c]).otherwise(F.col(c)) for c in columns}).select(df.columns)


def append(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert: rows after those of df; columns that either lacks become null."""
    return df.unionByName(rows, allowMissingColumns=True)

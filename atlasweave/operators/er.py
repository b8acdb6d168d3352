"""Entity resolution: records of one place from several sources become one.

Two passes: equal name and place keys, then equal coordinates. Within a group every field is chosen on its own, from the
most trusted source, then the longest value, then the earliest row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import coord_key, dedup_key, trimmed
from ..functions.values import SOURCE_PRIORITY

#: Fields that merge, all strings. zip is left out by the reference rule and merged on request.
FIELDS = ("name", "jurisdiction", "diocese", "deanery", "city", "state", "country", "phone", "website", "lat", "lng", "address", "clergy")


def priority(source: Column) -> Column:
    """How far a source is trusted; 0 for an unknown one, lists of sources included."""
    named = F.create_map(*[F.lit(x) for item in SOURCE_PRIORITY.items() for x in item])
    return F.coalesce(F.element_at(named, source), F.lit(0))


def merge_groups(df: DataFrame, keys: list[str], fields: tuple[str, ...], ord_col: str = "ord") -> DataFrame:
    """One row per key: each field by priority, length and order among its trimmed values that are not blank; sources in order, each once.

    Two aggregations, each with partial results before the shuffle: the best values of each source, then those of the
    key. So what a key brings together is one row for each of its sources, however many rows it has.
    """
    value = {c: trimmed(F.col(c)) for c in fields}
    rows = df.select(*keys, F.coalesce("source", F.lit("")).alias("source"), ord_col, *[v.alias(c) for c, v in value.items()])
    best = lambda c, rank: F.max(F.when(F.col(c) != "", rank)).alias(c)
    each = rows.groupBy(*keys, "source").agg(
        *[best(c, F.struct(F.length(c).alias("length"), (-F.col(ord_col)).alias("ord"), F.col(c).alias("value"))) for c in fields], F.min(ord_col).alias(ord_col), F.count("*").alias("n")
    )
    pri = priority(F.col("source"))
    winner = lambda c: F.coalesce(F.max(F.when(F.col(c).isNotNull(), F.struct(F.col("__pri"), F.col(c))))[c]["value"], F.lit("")).alias(c)
    listed = F.array_sort(F.collect_list(F.struct(F.col(ord_col), F.col("source"))))  # a row for each source
    parts = F.flatten(F.transform(listed, lambda x: F.transform(F.split(x["source"], ","), trimmed)))
    sources = F.array_join(F.array_distinct(F.filter(parts, lambda x: x != "")), ", ")
    return each.withColumn("__pri", pri).groupBy(*keys).agg(*[winner(c) for c in fields], sources.alias("source"), F.min(ord_col).alias(ord_col), F.sum("n").alias("merged_rows"))


def by_name(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """First pass: rows without a name key are dropped."""
    keyed = df.withColumn("dedup_key", dedup_key(F.col("name"), F.col("city"), F.col("state"))).filter("dedup_key <> ''")
    return merge_groups(keyed, ["dedup_key"], fields)


def by_place(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Second pass: rows at one place merge; rows without coordinates pass."""
    keyed = df.drop("merged_rows").withColumn("coord_key", coord_key(F.col("lat").try_cast("double"), F.col("lng").try_cast("double")))
    alone = keyed.filter("coord_key = ''").withColumn("merged_rows", F.lit(1).cast("long"))
    merged = merge_groups(keyed.filter("coord_key <> ''"), ["coord_key"], fields)
    columns = ["coord_key", *fields, "source", "ord", "merged_rows"]
    return alone.select(columns).unionByName(merged.select(columns))


def resolve(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    return by_place(by_name(df, fields), fields)


def stats(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row: rows in, rows out, and rows merged away over both passes, which are those with a name key less those out."""
    keyed = dedup_key(F.col("name"), F.col("city"), F.col("state")) != ""
    one = df.agg(F.count("*").alias("total"), F.count_if(keyed).alias("kept")).withColumn("k", F.lit(1))
    two = resolve(df, fields).agg(F.count("*").alias("unique_rows")).withColumn("k", F.lit(1))
    return one.join(two, "k").select("total", "unique_rows", (F.col("kept") - F.col("unique_rows")).alias("merged"))


def first_wins(df: DataFrame, keys: list[Column], ord_col: str = "ord") -> DataFrame:
    """The earliest row of each key."""
    order = Window.partitionBy(*keys).orderBy(ord_col)
    return df.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")



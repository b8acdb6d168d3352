"""Lookups against reference tables: hierarchy, registry, seats. Reference tables are small and broadcast only by Spark's own size check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, norm, trimmed


def parent_of(df: DataFrame, hierarchy: DataFrame, child_col: str, out_col: str = "parent") -> DataFrame:
    """The first parent (by ord) that has a child; 'Unknown' if none has. A column named like the new one gives way."""
    df = df.drop(out_col)
    first = hierarchy.groupBy(F.col("child").alias("__child")).agg(F.min_by("parent", "ord").alias(out_col))
    return df.join(first, df[child_col] == F.col("__child"), "left").drop("__child").withColumn(out_col, F.coalesce(out_col, F.lit("Unknown")))


#: Lengths of the parts by which strings are looked up in others.
_LENGTHS = (1, 2, 3, 6, 12, 24)


def _parts(c: Column, lengths: Column) -> Column:
    """Digests of all parts of a string that have one of the lengths."""
    at = lambda k: F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.xxhash64(F.substring(c, i, k)))
    return F.array_distinct(F.flatten(F.transform(F.filter(lengths, lambda k: k <= F.length(c)), at)))


def containment_candidates(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(needle, hay) of those that share the needle's rarest part of about half its length; all pairs contained are among them.

    Both are tables of distinct, non-empty strings in a column of that name. How often a part occurs is counted over all
    hays, so words that most strings have, such as a common beginning, bring no two together.
    """
    every = F.array(*[F.lit(k) for k in _LENGTHS])
    longest = F.array(F.array_max(F.filter(every, lambda k: k <= F.length("needle"))))
    held = hays.select("hay", F.explode(_parts(F.col("hay"), every)).alias("part"))
    counts = held.groupBy("part").agg(F.count("*").alias("times"))
    asked = needles.select("needle", F.explode(_parts(F.col("needle"), longest)).alias("part")).join(counts, "part", "left")
    rarest = asked.groupBy("needle").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "part")).alias("rarest"))
    return rarest.filter("rarest.times > 0").select("needle", F.col("rarest.part").alias("part")).join(held, "part").select("needle", "hay")


def contained(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(needle, hay) of distinct, non-empty strings of which one contains the other."""
    return containment_candidates(needles, hays).filter(F.expr("contains(hay, needle)"))


def fuzzy_names(names: DataFrame, registry: DataFrame, name_col: str = "name", fix: bool = False) -> DataFrame:
    """(name, match): the registry entry that equals a name, or whose letters contain or are contained in the name's.

    Entries are tried in the registry's order; an exact name comes first; a null name matches nothing. With fix, names without ASCII letters or digits
    match nothing, where they otherwise match the first entry. Matching is done once for each distinct row of letters, of
    names as of entries.
    """
    distinct = names.select(F.col(name_col).alias("name")).distinct().withColumn("n", norm(F.col("name")))
    ranked = registry.filter("entry IS NOT NULL").select(norm(F.col("entry")).alias("k"), F.struct("ord", "entry").alias("at"))
    entries = ranked.groupBy("k").agg(F.min("at").alias("at"))
    letters, keys = distinct.filter("n <> ''").select("n").distinct(), entries.filter("k <> ''").select("k")
    pairs = contained(keys.withColumnRenamed("k", "needle"), letters.withColumnRenamed("n", "hay")).select(F.col("hay").alias("n"), F.col("needle").alias("k"))
    pairs = pairs.unionByName(contained(letters.withColumnRenamed("n", "needle"), keys.withColumnRenamed("k", "hay")).select(F.col("needle").alias("n"), F.col("hay").alias("k")))
    met = pairs.join(entries, "k").groupBy("n").agg(F.min("at").alias("met"))
    # Entries without letters are in every name; names without letters are in every entry. Of either, one row at most.
    blank_entry = entries.filter("k = ''").select(F.lit(1).alias("one"), F.col("at").alias("empty"))
    first_entry = entries.agg(F.min("at").alias("first")).select(F.lit("").alias("n"), "first")
    exact = registry.filter("entry IS NOT NULL").groupBy(F.col("entry").alias("name")).count().select("name", F.col("name").alias("same"))
    out = distinct.withColumn("one", F.when(F.col("n") != "", 1)).join(met, "n", "left").join(F.broadcast(blank_entry), "one", "left").join(exact, "name", "left")
    if not fix:
        out = out.join(F.broadcast(first_entry), "n", "left")
    first = F.when(F.col("name").isNotNull(), F.col("first.entry")) if not fix else F.lit(None).cast("string")
    return out.select("name", F.coalesce("same", F.least("met", "empty")["entry"], first).alias("match"))


def canonical_group(df: DataFrame, registry: DataFrame, group_col: str, parent_col: str, out_col: str = "canonical") -> DataFrame:
    """The registry's name of a group; where none matches, the only entry of its parent; else the group, the parent, or 'Unknown'."""
    named = fuzzy_names(df.filter(~blank(F.col(group_col))), registry, group_col).withColumnRenamed("name", "__name")
    only = registry.groupBy(F.col("parent").alias("__parent")).agg(F.count("*").alias("__n"), F.min("entry").alias("__only")).filter("__n = 1")
    given = lambda c: F.nullif(trimmed(F.col(c)), F.lit(""))
    out = df.join(named, df[group_col] == F.col("__name"), "left").join(only, df[parent_col] == F.col("__parent"), "left")
    choice = F.coalesce(F.col("match"), F.col("__only"), given(group_col), given(parent_col), F.lit("Unknown"))
    return out.withColumn(out_col, choice).drop("__name", "match", "__parent", "__n", "__only")


def backfill(df: DataFrame, registry: DataFrame, parent_col: str, area_col: str, group_col: str) -> DataFrame:
    """Blank groups of rows that have a parent and an area get the registry entry of both: the longest name, the first of equals."""
    areas = registry.select(F.col("parent").alias("__p"), F.explode("areas").alias("__a"), "entry", "ord")
    best = areas.groupBy("__p", "__a").agg(F.max_by("entry", F.struct(F.length("entry"), -F.col("ord"))).alias("__entry"))
    out = df.join(best, (df[parent_col] == F.col("__p")) & (df[area_col] == F.col("__a")), "left")
    lacks = blank(F.col(group_col))
    fits = ~blank(F.col(parent_col)) & ~blank(F.col(area_col))
    return out.withColumn(group_col, F.when(lacks, F.coalesce(F.when(fits, F.col("__entry")), F.lit(""))).otherwise(F.col(group_col))).drop("__p", "__a", "__entry")


def with_seats(df: DataFrame, seats: DataFrame, city_col: str = "city", state_col: str = "state") -> DataFrame:
    """seat_list, the seats at a row's 'city, state' in their order; empty if none."""
    listed = seats.groupBy("seat").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "diocese", "type"))), lambda x: F.struct(x["diocese"].alias("diocese"), x["type"].alias("type"))).alias("seat_list"))
    key: Column = F.concat_ws(", ", df[city_col], df[state_col])
    return df.join(listed, key == listed["seat"], "left").drop("seat").withColumn("seat_list", F.coalesce("seat_list", F.expr("array()").cast("array<struct<diocese:string,type:string>>")))

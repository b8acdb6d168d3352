"""What the directory answers to readers: one function for each question, each a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, colour, importance, jittered
from .enrich import fuzzy_names, parent_of, with_seats

#: The region of places whose group no registry knows.
HOME_REGION = "North America"


def stats(records: DataFrame) -> DataFrame:
    """(level, key, n): all records, and those by parent, jurisdiction and state; blank parents and states don't count."""
    total = records.agg(F.lit("total").alias("level"), F.lit("").alias("key"), F.count("*").alias("n"))
    by = lambda c: records.groupBy(F.lit(c).alias("level"), F.col(c).alias("key")).agg(F.count("*").alias("n"))
    return total.unionByName(by("patriarchate").filter("key <> ''")).unionByName(by("jurisdiction")).unionByName(by("state").filter("key <> ''"))


def jurisdictions(records: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Each jurisdiction with its parent and colour, in order."""
    found = records.select("jurisdiction").distinct()
    return parent_of(found, hierarchy, "jurisdiction", "patriarchate").withColumn("colour", colour(F.col("jurisdiction"))).orderBy("jurisdiction")


def hierarchy_tree(records: DataFrame, hierarchy: DataFrame, registry: DataFrame) -> DataFrame:
    """(parent, jurisdictions): parents in order with their jurisdictions and those's groups of the registry, all with counts of records."""
    by_j = records.groupBy(F.col("jurisdiction").alias("__j")).agg(F.count("*").alias("__nj"))
    by_d = records.groupBy(F.col("jurisdiction").alias("__j"), F.col("diocese").alias("__d")).agg(F.count("*").alias("__nd"))
    groups = registry.join(by_d, (registry["parent"] == F.col("__j")) & (registry["entry"] == F.col("__d")), "left")
    leaf = F.struct(F.col("ord"), F.col("entry").alias("name"), "region", F.col("areas").alias("states"), "bishop", F.coalesce("__nd", F.lit(0)).alias("n"))
    groups = groups.groupBy(F.col("parent").alias("__jur")).agg(F.array_sort(F.collect_list(leaf)).alias("dioceses"))
    rows = hierarchy.join(by_j, hierarchy["child"] == F.col("__j"), "left").join(groups, hierarchy["child"] == F.col("__jur"), "left")
    node = F.struct(F.col("ord"), F.col("child").alias("name"), colour(F.col("child")).alias("colour"), F.coalesce("__nj", F.lit(0)).alias("n"), F.coalesce("dioceses", F.array().cast("array<struct<ord:int,name:string,region:string,states:array<string>,bishop:string,n:bigint>>")).alias("dioceses"))
    return rows.groupBy("parent").agg(F.array_sort(F.collect_list(node)).alias("jurisdictions"), F.min("ord").alias("ord")).orderBy("ord").select("parent", "jurisdictions")


def located_counts(records: DataFrame) -> DataFrame:
    """(key, n): located records of each group, and of each jurisdiction those without one; a name that is both has the sum, blank ones none."""
    there = records.filter("lat IS NOT NULL")
    key = F.when(~blank(F.col("diocese")), F.col("diocese")).otherwise(F.col("jurisdiction"))
    return there.groupBy(key.alias("key")).agg(F.count("*").alias("n")).filter(~blank(F.col("key")))


def with_registry(rows: DataFrame, registry: DataFrame, group_col: str = "diocese") -> DataFrame:
    """rows with bishop, region and areas of the registry entry that their group's name matches, null where none does."""
    named = fuzzy_names(rows.filter(~blank(F.col(group_col))), registry, group_col).withColumnRenamed("name", "__name")
    entry = registry.select(F.col("entry").alias("__entry"), "bishop", "region", F.col("areas").alias("states"))
    told = named.join(entry, F.col("match") == F.col("__entry")).drop("match", "__entry")
    return rows.join(told, rows[group_col] == F.col("__name"), "left").drop("__name")


def _known(c: str) -> Column:
    return F.nullif(F.col(c), F.lit("Unknown"))


def of_tier(polygons: DataFrame, tier: int, group: str | None = None) -> DataFrame:
    """Polygons of a tier, of one group if one is named."""
    rows = polygons.filter(F.col("tier") == tier)
    return rows.filter(F.col("diocese") == group) if group else rows


def map_groups(polygons: DataFrame, records: DataFrame, registry: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Outlines of groups with colour, count of located records (the group's, else its jurisdiction's, else 0), registry and parent."""
    counts = located_counts(records)
    rows = parent_of(with_registry(of_tier(polygons, 1), registry), hierarchy, "jurisdiction", "patriarchate")
    own, other = counts.select(F.col("key").alias("__k1"), F.col("n").alias("__n1")), counts.select(F.col("key").alias("__k2"), F.col("n").alias("__n2"))
    rows = rows.join(own, rows["diocese"] == F.col("__k1"), "left").join(other, rows["jurisdiction"] == F.col("__k2"), "left")
    return rows.select(
        "entity_type", "entity_id", "diocese", "jurisdiction", colour(F.col("jurisdiction")).alias("colour"), F.coalesce("__n1", "__n2", F.lit(0)).alias("n"), "bishop", "region",
        F.coalesce("states", F.array().cast("array<string>")).alias("states"), _known("patriarchate").alias("patriarchate"), "geojson",
    )


def map_cells(polygons: DataFrame, group: str | None = None) -> DataFrame:
    """Cells of representatives with a colour of their own near that of their jurisdiction."""
    shade = jittered(colour(F.col("jurisdiction")), F.col("entity_id"))
    return of_tier(polygons, 2, group).select("entity_type", "entity_id", "diocese", "jurisdiction", shade.alias("colour"), "geojson")


def map_points(records: DataFrame, registry: DataFrame, hierarchy: DataFrame, seats: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Located records as points with colour, importance, parent, registry and seats; more has points of other regions that are added."""
    there = records.filter("lat IS NOT NULL AND lng IS NOT NULL")
    rows = with_seats(parent_of(with_registry(there, registry), hierarchy, "jurisdiction", "patriarchate"), seats)
    made = rows.withColumns(
        {
            "colour": colour(F.col("jurisdiction")),
            "importance": importance(F.col("name")),
            "patriarchate": _known("patriarchate"),
            "region": F.coalesce("region", F.lit(HOME_REGION)),
            "seat_list": F.when(F.size("seat_list") > 0, F.col("seat_list")),
        }
    ).drop("states")
    return made if more is None else made.unionByName(european(more), allowMissingColumns=True)


def european(points: DataFrame) -> DataFrame:
    """Points of other regions with colour and importance where they have none."""
    have = {c.lower() for c in points.columns}
    own = lambda c, made: F.coalesce(F.col(c), made) if c in have else made
    return points.withColumns({"colour": own("colour", colour(F.col("jurisdiction"))), "importance": own("importance", importance(F.col("name")))})


def feature_counts(points: DataFrame) -> DataFrame:
    """One row: all features, those of Europe, and the others."""
    europe = F.count_if(F.col("region") == "Europe")
    return points.agg(F.count("*").alias("features"), europe.alias("european"), (F.count("*") - europe).alias("others"))


def map_meta(records: DataFrame, polygons: DataFrame, clusters: DataFrame, more: DataFrame) -> DataFrame:
    """One row of counters, the groups with their jurisdictions in order, and the regions."""
    one = F.lit(1).alias("k")
    located = records.agg(F.count("lat").alias("located")).withColumn("k", one)
    first = F.col("tier") == 1
    pairs = F.array_sort(F.collect_set(F.when(first, F.struct("jurisdiction", "diocese"))))
    shapes = polygons.agg(F.count_distinct(F.when(first, F.col("diocese"))).alias("groups"), F.count_if(first).alias("tier1"), F.count_if(F.col("tier") == 2).alias("tier2"), pairs.alias("dioceses")).withColumn("k", one)
    groups = clusters.agg(F.count("*").alias("clusters")).withColumn("k", one)
    other = more.agg(F.count("*").alias("european")).withColumn("k", one)
    row = located.join(other, "k").join(shapes, "k").join(groups, "k")  # one row each
    return row.select("located", "european", (F.col("located") + F.col("european")).alias("features"), "groups", "clusters", "tier1", "tier2", "dioceses", F.array(F.lit(HOME_REGION), F.lit("Europe")).alias("regions"))

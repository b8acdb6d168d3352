"""Queries of what is served to readers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import COLOURS, DEFAULT_COLOUR
from ..operators import served
from .carriers import REC, view

_JURISDICTIONS = tuple(COLOURS)[:4]
_NAME = "CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN 'Cathedral of ' WHEN 1 THEN 'Skete of ' WHEN 2 THEN 'Seminary of ' ELSE '' END"
_J = "CASE CAST(p_partkey % 5 AS INT) " + " ".join(f"WHEN {k} THEN '{j}'" for k, j in enumerate(_JURISDICTIONS)) + " ELSE 'Elsewhere' END"
#: Records as they are served: coordinates are numbers, jurisdictions have colours, some groups are blank.
PLACES = f"""SELECT ord AS id, {_NAME} || name AS name, {_J} AS jurisdiction, diocese, city, 'S' || CAST(ord % 6 AS VARCHAR(9)) AS state,
    CASE WHEN ord % 3 = 0 THEN '' ELSE 'P' || CAST(ord % 2 AS VARCHAR(9)) END AS patriarchate, CASE WHEN ord % 7 <> 0 THEN CAST(40 + ord % 9 AS DOUBLE) END AS lat,
    CASE WHEN ord % 7 <> 0 THEN CAST(-80 - ord % 8 AS DOUBLE) END AS lng FROM ({REC}) JOIN part ON p_partkey = ord"""
_NUMBERS = "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < {}"
REGISTRY = f"""SELECT CASE WHEN k = 0 THEN 'The Archdiocese 3' ELSE 'Diocese ' || CAST(k AS VARCHAR(9)) END AS entry, k AS ord, {_J.replace("p_partkey", "k")} AS parent,
    'R' || CAST(k % 2 AS VARCHAR(9)) AS region, CASE WHEN k % 3 = 0 THEN NULL ELSE 'Bishop ' || CAST(k AS VARCHAR(9)) END AS bishop FROM ({_NUMBERS.format(6)})"""
HIERARCHY = f"SELECT 'P' || CAST(k % 2 AS VARCHAR(9)) AS parent, {_J.replace('p_partkey', 'k')} AS child, k AS ord FROM ({_NUMBERS.format(4)})"
SEATS = f"SELECT 'Town ' || CAST(k % 3 AS VARCHAR(9)) || ', S' || CAST(k % 6 AS VARCHAR(9)) AS seat, 'Diocese ' || CAST(k AS VARCHAR(9)) AS diocese, 'see' AS type, k AS ord FROM ({_NUMBERS.format(8)})"
POLYGONS = f"""SELECT 'diocese' AS entity_type, diocese AS entity_id, diocese, min(jurisdiction) AS jurisdiction, 1 AS tier, '{{}}' AS geojson FROM ({PLACES}) WHERE diocese <> '' GROUP BY diocese
    UNION ALL SELECT 'diocese', jurisdiction, jurisdiction, jurisdiction, 1, '{{}}' FROM ({PLACES}) GROUP BY jurisdiction
    UNION ALL SELECT 'parish', 'p-' || CAST(id AS VARCHAR(19)), diocese, jurisdiction, 2, '{{}}' FROM ({PLACES})"""
EUROPE = f"SELECT 1000000 + k AS id, 'Basilica ' || CAST(k AS VARCHAR(9)) AS name, 'Church of Greece' AS jurisdiction, 'Europe' AS region FROM ({_NUMBERS.format(5)})"
_CITY = "CASE WHEN ord % 4 = 0 THEN 'Town ' || CAST(ord % 3 AS VARCHAR(9)) ELSE city END AS city"
PLACES = PLACES.replace("diocese, city,", f"diocese, {_CITY},")
POLYGONS = POLYGONS.replace("diocese, city,", f"diocese, {_CITY},")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "part", "nation")
    return spark.sql(PLACES)


def _registry(spark: SparkSession) -> DataFrame:
    return spark.sql(REGISTRY).withColumn("areas", F.array(F.concat(F.lit("S"), "ord"), F.lit("S9")))


def endpoint_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return served.stats(_places(spark, sf_dir))


def endpoint_jurisdictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _places(spark, sf_dir)
    return served.jurisdictions(rows, spark.sql(HIERARCHY)).withColumn("colour", F.array_join(F.col("colour").cast("array<string>"), ","))


def endpoint_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree, flattened to a row for each group."""
    tree = served.hierarchy_tree(_places(spark, sf_dir), spark.sql(HIERARCHY), _registry(spark))
    rows = tree.select("parent", F.explode("jurisdictions").alias("j")).select("parent", F.col("j.name").alias("jurisdiction"), F.col("j.n").alias("records"), F.posexplode_outer("j.dioceses").alias("at", "d"))
    return rows.select("parent", "jurisdiction", "records", F.col("at").cast("long").alias("at"), F.col("d.name").alias("name"), "d.region", "d.bishop", F.array_join("d.states", ",").alias("states"), F.col("d.n").alias("n"))


def endpoint_map_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = served.map_groups(_polygons(spark, sf_dir), _places(spark, sf_dir), _registry(spark), spark.sql(HIERARCHY))
    return rows.drop("geojson").withColumns({"colour": F.array_join(F.col("colour").cast("array<string>"), ","), "states": F.array_join("states", ",")})


def _polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "part", "nation")
    return spark.sql(POLYGONS)


def endpoint_map_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells, and those of one group, marked."""
    polygons = _polygons(spark, sf_dir)
    rows = served.map_cells(polygons).withColumn("asked", F.lit("")).unionByName(served.map_cells(polygons, "Diocese 3").withColumn("asked", F.lit("Diocese 3")))
    return rows.select("asked", "entity_id", "diocese", "jurisdiction", F.array_join(F.col("colour").cast("array<string>"), ",").alias("colour"))


def endpoint_map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = served.map_points(_places(spark, sf_dir), _registry(spark), spark.sql(HIERARCHY), spark.sql(SEATS), spark.sql(EUROPE))
    return rows.select("id", "name", "jurisdiction", "diocese", "importance", "patriarchate", "bishop", "region", F.array_join(F.col("colour").cast("array<string>"), ",").alias("colour"), F.array_join("seat_list.diocese", ";").alias("seats"), "lat", "lng")


def endpoint_feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return served.feature_counts(served.map_points(_places(spark, sf_dir), _registry(spark), spark.sql(HIERARCHY), spark.sql(SEATS), spark.sql(EUROPE)))


def endpoint_map_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _places(spark, sf_dir)
    found = served.map_meta(places, _polygons(spark, sf_dir), places.select("state").distinct(), spark.sql(EUROPE))
    pairs = F.array_join(F.transform("dioceses", lambda x: F.concat_ws("/", x["jurisdiction"], x["diocese"])), ";")
    return found.withColumns({"dioceses": pairs, "regions": F.array_join("regions", ",")})


def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located records of each group, and of each jurisdiction those without one."""
    return served.located_counts(_places(spark, sf_dir))


QUERIES = {f.__name__: f for f in (endpoint_stats, endpoint_jurisdictions, endpoint_hierarchy, endpoint_map_groups, endpoint_map_cells, endpoint_map_points, endpoint_feature_counts, endpoint_map_meta, group_counts)}

_COLOUR = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN '{','.join(map(str, v))}'" for k, v in COLOURS.items()) + f" ELSE '{','.join(map(str, DEFAULT_COLOUR))}' END"
_PART = lambda k: "CASE jurisdiction " + " ".join(f"WHEN '{j}' THEN {v[k]}" for j, v in COLOURS.items()) + f" ELSE {DEFAULT_COLOUR[k]} END"
_WITH = f"""p AS ({PLACES}), g AS (SELECT *, 'S' || ord || ',S9' AS states FROM ({REGISTRY})), h AS ({HIERARCHY}), seats AS ({SEATS}), europe AS ({EUROPE}), poly AS ({POLYGONS}),
    names AS (SELECT DISTINCT diocese AS name FROM poly WHERE diocese <> ''),
    match AS (SELECT name, arg_min(entry, (CASE WHEN entry = name THEN 0 ELSE 1 END, ord)) AS entry FROM names JOIN g
        ON contains(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), regexp_replace(lower(entry), '[^a-z0-9]', '', 'g'))
        OR contains(regexp_replace(lower(entry), '[^a-z0-9]', '', 'g'), regexp_replace(lower(name), '[^a-z0-9]', '', 'g')) GROUP BY name),
    known AS (SELECT name AS d, g.* FROM match JOIN g USING (entry)),
    first_parent AS (SELECT child, arg_min(parent, ord) AS pat FROM h GROUP BY child),
    counts AS (SELECT CASE WHEN diocese <> '' THEN diocese ELSE jurisdiction END AS key, count(*) AS n FROM p WHERE lat IS NOT NULL GROUP BY 1),
    seated AS (SELECT seat, string_agg(diocese, ';' ORDER BY ord) AS s FROM seats GROUP BY seat),
    points AS (SELECT p.id, p.name, p.jurisdiction, p.diocese, CASE WHEN p.name LIKE 'Cathedral%' THEN 'cathedral' WHEN p.name LIKE 'Skete%' THEN 'monastery' WHEN p.name LIKE 'Seminary%' THEN 'seminary' END AS importance,
        pat AS patriarchate, bishop, coalesce(region, 'North America') AS region, {_COLOUR("jurisdiction")} AS colour, s AS seats, lat, lng
        FROM p LEFT JOIN known ON d = diocese AND diocese <> '' LEFT JOIN first_parent ON child = jurisdiction LEFT JOIN seated ON seat = city || ', ' || state WHERE lat IS NOT NULL AND lng IS NOT NULL
        UNION ALL SELECT id, name, jurisdiction, NULL, 'notable', NULL, NULL, region, {_COLOUR("jurisdiction")}, NULL, NULL, NULL FROM europe)"""
_SHADE = " || ',' || ".join(f"CAST(greatest(0, least(255, ({_PART(k)}) + m)) AS VARCHAR)" for k in range(3)) + f" || ',' || CAST(({_PART(3)}) AS VARCHAR)"
ORACLES = {
    "endpoint_stats": f"""WITH {_WITH} SELECT 'total' AS level, '' AS key, count(*) AS n FROM p UNION ALL SELECT 'patriarchate', patriarchate, count(*) FROM p WHERE patriarchate <> '' GROUP BY 2
        UNION ALL SELECT 'jurisdiction', jurisdiction, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'state', state, count(*) FROM p WHERE state <> '' GROUP BY 2""",
    "endpoint_jurisdictions": f"WITH {_WITH} SELECT DISTINCT jurisdiction, coalesce(pat, 'Unknown') AS patriarchate, {_COLOUR('jurisdiction')} AS colour FROM p LEFT JOIN first_parent ON child = jurisdiction",
    "endpoint_hierarchy": f"""WITH {_WITH}, j AS (SELECT jurisdiction, count(*) AS n FROM p GROUP BY 1), jd AS (SELECT jurisdiction, diocese, count(*) AS n FROM p GROUP BY 1, 2)
        SELECT h.parent, child AS jurisdiction, coalesce(j.n, 0) AS records, CASE WHEN entry IS NOT NULL THEN row_number() OVER (PARTITION BY child ORDER BY g.ord) - 1 END AS at, entry AS name, region, bishop, states,
            CASE WHEN entry IS NOT NULL THEN coalesce(jd.n, 0) END AS n
        FROM h LEFT JOIN j ON j.jurisdiction = child LEFT JOIN g ON g.parent = child LEFT JOIN jd ON jd.jurisdiction = child AND jd.diocese = entry""",
    "endpoint_map_groups": f"""WITH {_WITH} SELECT entity_type, entity_id, diocese, jurisdiction, {_COLOUR("jurisdiction")} AS colour, coalesce(a.n, b.n, 0) AS n, bishop, region, coalesce(states, '') AS states, pat AS patriarchate
        FROM poly LEFT JOIN known ON d = diocese LEFT JOIN first_parent ON child = jurisdiction LEFT JOIN counts a ON a.key = diocese LEFT JOIN counts b ON b.key = jurisdiction WHERE tier = 1""",
    "endpoint_map_cells": f"""WITH {_WITH}, c AS (SELECT *, CAST(list_sum(list_transform(string_split(entity_id, ''), lambda x: ascii(x))) AS BIGINT) % 60 - 30 AS m FROM poly WHERE tier = 2),
        all_cells AS (SELECT entity_id, diocese, jurisdiction, {_SHADE} AS colour FROM c)
        SELECT '' AS asked, * FROM all_cells UNION ALL SELECT 'Diocese 3', * FROM all_cells WHERE diocese = 'Diocese 3'""",
    "endpoint_map_points": f"WITH {_WITH} SELECT * FROM points",
    "endpoint_feature_counts": f"WITH {_WITH} SELECT count(*) AS features, count(*) FILTER (region = 'Europe') AS european, count(*) FILTER (region <> 'Europe') AS others FROM points",
    "endpoint_map_meta": f"""WITH {_WITH}, e AS (SELECT count(*) AS n FROM europe), l AS (SELECT count(lat) AS n FROM p)
        SELECT l.n AS located, e.n AS european, l.n + e.n AS features, (SELECT count(DISTINCT diocese) FROM poly WHERE tier = 1) AS groups, (SELECT count(DISTINCT state) FROM p) AS clusters,
            (SELECT count(*) FROM poly WHERE tier = 1) AS tier1, (SELECT count(*) FROM poly WHERE tier = 2) AS tier2,
            (SELECT string_agg(x, ';' ORDER BY j, d) FROM (SELECT DISTINCT jurisdiction AS j, diocese AS d, jurisdiction || '/' || diocese AS x FROM poly WHERE tier = 1)) AS dioceses, 'North America,Europe' AS regions FROM l, e""",
    "group_counts": f"WITH {_WITH} SELECT * FROM counts",
}

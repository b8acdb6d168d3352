"""Queries of what is served, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import output
from ..sources import files, html
from ..stages import shared_folder
from .carriers import GEO_DUCK, REC, geo, rec, table, view


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table of a snapshot, by name."""
    parts = {"records": rec(spark, sf_dir), "points": geo(spark, sf_dir), "nations": table(spark, sf_dir, "nation")}
    counts = [df.agg(F.count("*").alias("rows")).withColumn("name", F.lit(name)) for name, df in parts.items()]
    return files.union_all(counts).select("name", "rows")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of each group and its names in order, all of them."""
    rows = output.member_rows(_members(spark, sf_dir), "key")
    return rows.groupBy("key").agg(F.count("*").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"]), ",").alias("names"))


def member_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All members of each group, in order."""
    return output.member_rows(_members(spark, sf_dir), "key")


def geocode_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without coordinates take those of their address where a gazetteer has it."""
    r = rec(spark, sf_dir)
    number = lambda c: F.col(c).try_cast("double").alias(c)
    rows = r.select("ord", "address", "city", "state", "country", number("lat"), number("lng"))
    known = rows.filter("ord % 14 = 0").select(F.concat_ws(", ", "address", F.nullif("city", F.lit("")), "state", "country").alias("place"), (F.col("ord") % 90).cast("double").alias("lat"), F.lit(-1.5).alias("lng"))
    return output.fill_coordinates(rows, known).select("ord", "lat", "lng")


def migrate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations brought to a schema with a column more."""
    schema = spark.createDataFrame([], "n_nationkey long, n_name string, patriarchate string").schema
    return output.with_columns_of(table(spark, sf_dir, "nation"), schema)


def error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "customer")
    rows = spark.sql("SELECT c_custkey, CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 404 END AS status, CASE CAST(c_custkey % 6 AS INT) WHEN 3 THEN 'ETIMEDOUT' WHEN 4 THEN 'ENOTFOUND' END AS code FROM customer")
    return rows.select("c_custkey", files.classify_error("status", "code").alias("kind"))


def coordinate_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "supplier")
    pages = spark.sql("SELECT s_suppkey, CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN 'new LatLng( 4' || (s_suppkey % 10) || '.5 , -80.25 )' WHEN 1 THEN '<a href=\"x/maps?ll=41.5,-8' || (s_suppkey % 10) || '.5\">' WHEN 2 THEN '<i data-lat=\"1.5\" data-lng=\"2.5\">' ELSE 'none' END AS h FROM supplier")
    return pages.select("s_suppkey", html.coordinates(F.col("h")).alias("at"))


def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "supplier")
    pages = spark.sql("SELECT s_suppkey AS page_id, '12 Main St<br>' || s_name || ', NY 10001<BR/>Fr. John<br> (312) 555-0147 <br>' AS html FROM supplier")
    return html.lines(pages).groupBy("kind").agg(F.count("*").alias("n"))


def region_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with name, colour and size of their group, 'Unknown' names as null."""
    g = geo(spark, sf_dir)
    props = g.groupBy("grp").agg(F.count("*").alias("size")).withColumn("name", F.when(F.col("grp") % 3 == 0, "Unknown").otherwise(F.concat(F.lit("Group "), "grp")))
    return g.join(props, "grp").select("id", F.nullif("name", F.lit("Unknown")).alias("name"), "size")


def snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot written to the shared folder; its manifest."""
    tables = {"records": rec(spark, sf_dir), "nations": table(spark, sf_dir, "nation")}
    return output.snapshot(spark, tables, f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}", "1").select("name", "rows")


QUERIES = {f.__name__: f for f in (manifest, members, member_rows, geocode_fill, migrate_columns, error_class, coordinate_extract, line_kinds, region_props, snapshot_files)}
_PLACE = "concat_ws(', ', nullif(trim(address), ''), nullif(trim(city), ''), nullif(trim(state), ''), coalesce(nullif(trim(country), ''), 'USA'))"
ORACLES = {
    "manifest": f"SELECT 'records' AS name, count(*) AS rows FROM ({REC}) UNION ALL SELECT 'points', count(*) FROM ({GEO_DUCK}) UNION ALL SELECT 'nations', count(*) FROM nation",
    "members": """SELECT s_nationkey AS key, count(*) AS size, array_to_string(list(s_name ORDER BY s_suppkey), ',') AS names FROM supplier GROUP BY 1""",
    "member_rows": "SELECT s_nationkey AS key, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey, s_name) AS position, s_suppkey AS id, s_name AS name FROM supplier",
    "geocode_fill": f"""WITH r AS (SELECT ord, address, city, state, country, TRY_CAST(lat AS DOUBLE) AS la, TRY_CAST(lng AS DOUBLE) AS ln FROM ({REC})),
        k AS (SELECT {_PLACE} AS place, min(CAST(ord % 90 AS DOUBLE)) AS kla FROM r WHERE ord % 14 = 0 GROUP BY 1)
        SELECT ord, coalesce(la, kla) AS lat, CASE WHEN la IS NULL AND kla IS NOT NULL THEN -1.5 ELSE ln END AS lng FROM r LEFT JOIN k ON la IS NULL AND {_PLACE} = place""",
    "migrate_columns": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(NULL AS VARCHAR) AS patriarchate FROM nation",
    "error_class": "SELECT c_custkey, CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'server' WHEN 2 THEN 'client' WHEN 3 THEN 'timeout' WHEN 4 THEN 'network' ELSE 'unknown' END AS kind FROM customer",
    "coordinate_extract": """SELECT s_suppkey, CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN '4' || (s_suppkey % 10) || '.5,-80.25' WHEN 1 THEN '41.5,-8' || (s_suppkey % 10) || '.5' WHEN 2 THEN '1.5,2.5' ELSE '' END AS at FROM supplier""",
    "line_kinds": "SELECT kind, (SELECT count(*) FROM supplier) AS n FROM (VALUES ('address'), ('city'), ('clergy'), ('phone')) v(kind)",
    "region_props": f"""WITH g AS ({GEO_DUCK}) SELECT id, CASE WHEN grp % 3 = 0 THEN NULL ELSE 'Group ' || grp END AS name, count(*) OVER (PARTITION BY grp) AS size FROM g""",
    "snapshot_files": "SELECT 'records' AS name, count(*) AS rows FROM part UNION ALL SELECT 'nations', count(*) FROM nation",
}

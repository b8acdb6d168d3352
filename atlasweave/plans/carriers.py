"""Directory-shaped tables derived from the test tables, in Spark SQL and, word for word the same where possible, in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.values import SOURCE_PRIORITY

SOURCES = tuple(SOURCE_PRIORITY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


_SOURCE_CASE = "CASE CAST(p_partkey % 12 AS INT) " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(SOURCES)) + " END"
_SOURCE_CASE = f"CASE WHEN p_partkey % 37 = 0 THEN NULL WHEN p_partkey % 41 = 0 THEN '  ' WHEN p_partkey % 43 = 0 THEN 'oca , goarch' ELSE {_SOURCE_CASE} END"

#: Records of places: names and cities that recur, so that they merge.
REC = f"""
SELECT p_partkey AS ord, p_name AS name, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_type END AS city, p_brand AS state,
       {_SOURCE_CASE} AS source, 'J' || CAST(p_size % 5 AS VARCHAR(9)) AS jurisdiction,
       CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'Diocese ' || CAST(p_size % 7 AS VARCHAR(9)) END AS diocese,
       CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN '  Deanery ' || CAST(p_size AS VARCHAR(9)) || ' \u00a0' WHEN 1 THEN ' \u00a0 ' WHEN 2 THEN NULL ELSE '' END AS deanery, 'USA' AS country,
       CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN '     (312) 5     ' ELSE '(312) 555-' || CAST(1000 + p_partkey % 9000 AS VARCHAR(9)) END AS phone,
       CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'https://place' || CAST(p_partkey AS VARCHAR(19)) || '.example' END AS website,
       CASE WHEN p_partkey % 7 = 0 THEN '' ELSE CAST(p_size AS VARCHAR(9)) || '.5' END AS lat,
       CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '-' || CAST(p_size + 40 AS VARCHAR(9)) || '.25' END AS lng,
       CAST(p_size AS VARCHAR(9)) || ' ' || p_brand || ' Street' AS address,
       CASE WHEN p_partkey % 2 = 0 THEN 'Fr. ' || p_brand ELSE '' END AS clergy
FROM part"""

#: Points in groups, dense enough for clusters.
GEO_SPARK = "SELECT vec_id AS id, label AS grp, 45 + 5 * CAST(embedding[0] AS DOUBLE) AS lat, -95 + 8 * CAST(embedding[1] AS DOUBLE) AS lng FROM embeddings WHERE vec_id IS NOT NULL AND size(embedding) > 1"
GEO_DUCK = "SELECT vec_id AS id, label AS grp, 45 + 5 * CAST(embedding[1] AS DOUBLE) AS lat, -95 + 8 * CAST(embedding[2] AS DOUBLE) AS lng FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 1"

#: Visits and the like.
ACT = "SELECT event_id, user_id, event_type, CAST(floor(value) AS BIGINT) % 50 AS place_id, ts, value FROM events"


def rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "part")
    return spark.sql(REC)


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "embeddings")
    return spark.sql(GEO_SPARK)


def act(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "events")
    return spark.sql(ACT)

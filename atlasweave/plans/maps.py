"""Queries of distances, clusters, regions and map output, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import KM, MILES
from ..operators import polygons, spatial
from .carriers import GEO_DUCK, REC, geo, rec

BOX = (-100.0, 42.0, -90.0, 48.0)
_DIST = lambda a, b, c, d, r=KM: (
    f"({r} * 2 * atan2(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)), "
    f"sqrt(1 - (pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"
)
_NN = f"""pts AS ({GEO_DUCK}), d AS (SELECT a.grp, a.id AS a, b.id AS b, {_DIST("a.lat", "a.lng", "b.lat", "b.lng")} AS km FROM pts a JOIN pts b ON a.grp = b.grp AND a.id <> b.id),
    nn AS (SELECT grp, a AS id, min(km) AS nn FROM d GROUP BY 1, 2), s AS (SELECT grp, list_sort(list(nn)) AS l, count(*) AS n FROM nn GROUP BY 1),
    eps AS (SELECT grp, n, CASE WHEN n < 3 THEN 8.0 ELSE greatest(0.5, least(50.0, l[CAST(floor(n * 0.15) AS INT) + 1])) END AS eps FROM s)"""
_COMP = f"""{_NN}, e AS (SELECT d.a, d.b FROM d JOIN eps USING (grp) WHERE km <= eps AND n > 2), reach AS (SELECT a AS id, a AS r FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.r = e.a),
    comp AS (SELECT id, min(r) AS cluster FROM reach GROUP BY id)"""


def nn_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest_distances(geo(spark, sf_dir)).select("grp", "id", F.round("nn", 6).alias("nn"))


def eps_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.adaptive_eps(geo(spark, sf_dir)).select("grp", "n", F.round("eps", 6).alias("eps"))


def dbscan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.clusters(geo(spark, sf_dir)).select("id", "grp", "cluster")


def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = geo(spark, sf_dir)
    return spatial.summary(points, spatial.clusters(points)).select("cluster", "grp", *[F.round(c, 6).alias(c) for c in ("centroid_lat", "centroid_lng", "radius")], "point_count")


def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each cluster and each point outside one."""
    points = geo(spark, sf_dir)
    return spatial.representatives(points, spatial.clusters(points)).select("key", "grp", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest group centroid of each point's jurisdiction."""
    points = geo(spark, sf_dir).withColumn("part", F.col("grp") % 3)
    sites = points.groupBy("part", F.col("grp").alias("key")).agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng")).select("part", "key", F.col("key").alias("ord"), "lat", "lng")
    return spatial.nearest_of(points, sites)


def redistribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a diocese come to the nearest diocese of their jurisdiction, where it has any."""
    r = rec(spark, sf_dir).filter("lat <> '' AND lng <> ''")
    grp = F.coalesce(F.nullif("diocese", F.lit("")), "jurisdiction").alias("grp")
    return spatial.redistribute(r.select(F.col("ord").alias("id"), grp, "jurisdiction", F.col("lat").cast("double"), F.col("lng").cast("double"))).select("id", "grp")


def knn_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.closest(geo(spark, sf_dir), 45.0, -95.0).select("id", F.round("miles", 6).alias("miles"), "filtered")


def knn_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = geo(spark, sf_dir)
    words = lambda w: F.concat(F.lit("Group "), "grp").ilike(w)
    hit = spatial.closest(points, 45.0, -95.0, words=words("%GROUP 3%")).withColumn("ask", F.lit("hit"))
    miss = spatial.closest(points, 45.0, -95.0, words=words("%none%")).withColumn("ask", F.lit("miss"))
    return hit.unionByName(miss).select("ask", "id", F.round("miles", 6).alias("miles"), "filtered")


def voronoi_dominance_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest group centroid, in the plane of degrees, for each point of a grid."""
    sites = geo(spark, sf_dir).groupBy(F.col("grp").alias("key")).agg(F.avg("lng").alias("x"), F.avg("lat").alias("y"))
    grid = spark.range(61 * 41).select("id", (44 + (F.col("id") % 41) * 0.05).alias("y"), (-97 + F.floor(F.col("id") / 41) * 0.05).alias("x"))
    return spatial.nearest_in_plane(grid, sites).select(F.col("id").alias("cell"), F.col("key").alias("grp"))


def convex_hull_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    hulls = polygons.hulls(geo(spark, sf_dir))
    return hulls.select("grp", F.explode("ring").alias("p")).select("grp", F.round(F.col("p")[0], 6).alias("lng"), F.round(F.col("p")[1], 6).alias("lat"))


def buffer_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons.hulls(geo(spark, sf_dir), buffer_km=30.0)


def concave_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons.concave_hulls(geo(spark, sf_dir), longest=0.5)


def voronoi_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One diagram over all representatives: a cell for each."""
    points = geo(spark, sf_dir)
    sites = spatial.representatives(points, spatial.clusters(points))
    return polygons.voronoi(sites.select(F.col("key").alias("id"), "lat", "lng"), BOX)


def group_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concave outlines of groups, grown by 30 km."""
    return polygons.outlines(geo(spark, sf_dir))


def geojson_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A GeoJSON feature of each point as text, parsed again to show its parts."""
    g = geo(spark, sf_dir)
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("id"), F.concat(F.lit("g"), "grp").alias("name")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(F.round("lng", 6), F.round("lat", 6)).alias("coordinates")).alias("geometry")))
    back = F.from_json(feature, "type string, properties struct<id: bigint, name: string>, geometry struct<type: string, coordinates: array<double>>")
    return g.select(back.alias("f")).select("f.properties.id", "f.properties.name", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates")[0].alias("lng"), F.col("f.geometry.coordinates")[1].alias("lat"))


def map_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, r = geo(spark, sf_dir), rec(spark, sf_dir)
    a = g.agg(F.count("*").alias("points"), F.countDistinct("grp").alias("groups")).withColumn("k", F.lit(1))
    b = r.agg(F.count("*").alias("records"), F.countDistinct("jurisdiction").alias("jurisdictions"), F.count_if(F.col("lat") != "").alias("located"), F.array_join(F.array_sort(F.collect_set("jurisdiction")), ",").alias("names")).withColumn("k", F.lit(1))
    return a.join(b, "k").drop("k")


QUERIES = {f.__name__: f for f in (nn_distance, eps_percentile, dbscan_clusters, cluster_summary, representatives, nearest_centroid, redistribute, knn_top10, knn_fallback, voronoi_dominance_grid, convex_hull_vertices, buffer_hull, concave_hull, voronoi_cells, group_outlines, geojson_points, map_meta)}

_MILES = f"SELECT *, {_DIST('CAST(45 AS DOUBLE)', 'CAST(-95 AS DOUBLE)', 'lat', 'lng', MILES)} AS m FROM ({GEO_DUCK})"
_SUMMARY = f"""{_COMP}, rows AS (SELECT pts.*, cluster FROM pts JOIN comp USING (id)), c AS (SELECT cluster, min(grp) AS grp, avg(lat) AS clat, avg(lng) AS clng, count(*) AS n FROM rows GROUP BY 1)"""
ORACLES = {
    "nn_distance": f"WITH {_NN} SELECT grp, id, round(nn, 6) AS nn FROM nn",
    "eps_percentile": f"WITH {_NN} SELECT grp, n, round(eps, 6) AS eps FROM eps",
    "dbscan_clusters": f"WITH RECURSIVE {_COMP} SELECT id, grp, cluster FROM pts LEFT JOIN comp USING (id)",
    "cluster_summary": f"""WITH RECURSIVE {_SUMMARY} SELECT cluster, c.grp, round(clat, 6) AS centroid_lat, round(clng, 6) AS centroid_lng, round(max({_DIST("lat", "lng", "clat", "clng")}), 6) AS radius, n AS point_count
        FROM rows JOIN c USING (cluster) GROUP BY cluster, c.grp, clat, clng, n""",
    "representatives": f"""WITH RECURSIVE {_SUMMARY} SELECT 'c-' || cluster AS key, grp, round(clat, 6) AS lat, round(clng, 6) AS lng FROM c
        UNION ALL SELECT 'p-' || id, grp, round(lat, 6), round(lng, 6) FROM pts WHERE id NOT IN (SELECT id FROM comp)""",
    "nearest_centroid": f"""WITH pts AS ({GEO_DUCK}), s AS (SELECT grp AS key, avg(lat) AS slat, avg(lng) AS slng FROM pts GROUP BY 1), d AS (SELECT id, key, {_DIST("lat", "lng", "slat", "slng")} AS km FROM pts JOIN s ON pts.grp % 3 = s.key % 3)
        SELECT id, arg_min(key, (km, key)) AS nearest, round(min(km), 6) AS km FROM d GROUP BY id""",
    "redistribute": f"""WITH r AS (SELECT ord AS id, coalesce(nullif(diocese, ''), jurisdiction) AS grp, jurisdiction, CAST(lat AS DOUBLE) AS lat, CAST(lng AS DOUBLE) AS lng FROM ({REC}) WHERE lat <> '' AND lng <> ''),
        g AS (SELECT grp AS key, arg_min(jurisdiction, id) AS j, min(id) AS o, avg(lat) AS slat, avg(lng) AS slng FROM r GROUP BY 1), s AS (SELECT * FROM g WHERE key <> j AND key NOT IN (SELECT j FROM g WHERE key <> j)),
        d AS (SELECT id, arg_min(key, ({_DIST("lat", "lng", "slat", "slng")}, o)) AS nearest FROM r JOIN s ON grp = j GROUP BY id)
        SELECT id, coalesce(nearest, grp) AS grp FROM r LEFT JOIN d USING (id)""",
    "knn_top10": f"SELECT id, round(m, 6) AS miles, false AS filtered FROM ({_MILES}) ORDER BY m, id LIMIT 10",
    "knn_fallback": f"""WITH q AS ({_MILES}) SELECT * FROM (SELECT 'hit' AS ask, id, round(m, 6) AS miles, true AS filtered FROM q WHERE 'Group ' || grp ILIKE '%GROUP 3%' ORDER BY m, id LIMIT 10)
        UNION ALL SELECT * FROM (SELECT 'miss', id, round(m, 6), false FROM q ORDER BY m, id LIMIT 10)""",
    "voronoi_dominance_grid": f"""WITH s AS (SELECT grp, avg(lat) AS slat, avg(lng) AS slng FROM ({GEO_DUCK}) GROUP BY 1), g AS (SELECT r AS cell, 44 + (r % 41) * 0.05::DOUBLE AS glat, -97 + (r // 41) * 0.05::DOUBLE AS glng FROM range(61 * 41) t(r))
        SELECT cell, arg_min(grp, (round(pow(glat - slat, 2) + pow(glng - slng, 2), 9), grp)) AS grp FROM g, s GROUP BY cell""",
    "convex_hull_vertices": f"""WITH p AS ({GEO_DUCK}), e AS (SELECT a.grp, a.id AS i, b.id AS j FROM p a JOIN p b ON a.grp = b.grp AND a.id <> b.id
            WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.grp = a.grp AND c.id <> a.id AND c.id <> b.id AND (b.lng - a.lng) * (c.lat - a.lat) - (b.lat - a.lat) * (c.lng - a.lng) < 0))
        SELECT DISTINCT p.grp, round(lng, 6) AS lng, round(lat, 6) AS lat FROM p JOIN e ON e.i = p.id""",
    "geojson_points": f"SELECT id, 'g' || grp AS name, 'Point' AS kind, round(lng, 6) AS lng, round(lat, 6) AS lat FROM ({GEO_DUCK})",
    "map_meta": f"""WITH r AS ({REC}) SELECT (SELECT count(*) FROM ({GEO_DUCK})) AS points, (SELECT count(DISTINCT grp) FROM ({GEO_DUCK})) AS groups, count(*) AS records,
        count(DISTINCT jurisdiction) AS jurisdictions, count(*) FILTER (lat <> '') AS located, string_agg(DISTINCT jurisdiction, ',' ORDER BY jurisdiction) AS names FROM r""",
}

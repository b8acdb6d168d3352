"""Nearest neighbours, density clusters and dominance regions over points (id, grp, lat, lng).

Self joins are kept narrow by cells: points are taken as vectors in space and dealt to cubes whose side is the chord of the
radius, so a point meets only points of its own and the adjacent cubes that the sphere passes through. Cubes have no seam at
180 degrees and no poles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import KM, MILES, haversine
from ..stages import staged
from .components import connected_components

KM_PER_DEGREE = 111.0
#: Places in a cell from which on it counts as dense, and bins of a round that looks for an order statistic.
CROWD, BINS = 64, 4096
CELL = ["cx", "cy", "cz"]


def _chord(km: Column) -> Column:
    """The straight distance of points that are km apart on the sphere."""
    return 2 * KM * F.sin(F.least(km / (2 * KM), F.lit(1.5707963267948966)))


def _cells(df: DataFrame, side: Column, around: bool) -> DataFrame:
    """Cubes of a side in km; around gives those too that are adjacent and reach the sphere."""
    lat, lng = F.radians("lat"), F.radians("lng")
    vector = {"cx": KM * F.cos(lat) * F.cos(lng), "cy": KM * F.cos(lat) * F.sin(lng), "cz": KM * F.sin(lat)}
    df = df.withColumns({c: F.floor(x / side) for c, x in vector.items()})
    if not around:
        return df
    for c in CELL:
        df = df.withColumn(c, F.explode(F.array(*[F.col(c) + k for k in (-1, 0, 1)])))
    edges = [(F.col(c) * side, (F.col(c) + 1) * side) for c in CELL]
    least = sum((F.when((lo <= 0) & (hi >= 0), 0.0).otherwise(F.least(lo * lo, hi * hi)) for lo, hi in edges), F.lit(0.0))
    most = sum((F.greatest(lo * lo, hi * hi) for lo, hi in edges), F.lit(0.0))
    return df.filter((least <= KM**2 * (1 + 1e-9)) & (most >= KM**2 * (1 - 1e-9)))


def near_pairs(asking: DataFrame, there: DataFrame, km_col: str = "eps", others: bool = True) -> DataFrame:
    """(grp, a, b, km) of a point that asks and one of its group that is there, within km_col, which is the same throughout a group.

    With others, a point is not near to itself, that is, to its id.
    """
    side = _chord(F.col(km_col)) * (1 + 1e-9) + 1e-9
    left = _cells(asking.select("grp", "id", "lat", "lng", km_col), side, True).select("grp", *CELL, F.col("id").alias("a"), F.col("lat").alias("lat1"), F.col("lng").alias("lng1"), F.col(km_col).alias("limit"))
    right = _cells(there.select("grp", "id", "lat", "lng", km_col), side, False).select("grp", *CELL, F.col("id").alias("b"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    km = haversine(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2"))
    met = left.join(right, ["grp", *CELL])
    return (met.filter("a <> b") if others else met).withColumn("km", km).filter("km <= limit").select("grp", "a", "b", "km")


def neighbours(points: DataFrame, km_col: str = "eps") -> DataFrame:
    """(grp, a, b, km) of pairs a <> b of one group within km_col of each other; km_col is the same throughout a group."""
    return near_pairs(points, points, km_col)


def links_within(points: DataFrame) -> DataFrame:
    """(a, b) links that connect the same points as those within eps of each other, without all pairs of a dense place.

    Points of a cell whose diagonal is below eps are linked to the cell's least id; between cells, points are compared
    that lie at one place only once, and only with cells that reach within eps.
    """
    fine = _cells(points.select("grp", "id", "lat", "lng", "eps"), _chord(F.col("eps")) * 0.5 + 1e-9, False)
    places = fine.groupBy("grp", *CELL, "lat", "lng", "eps").agg(F.min("id").alias("id"))
    home = fine.groupBy("grp", *CELL).agg(F.min("id").alias("home"))
    inside = fine.join(home, ["grp", *CELL]).filter("id <> home").select(F.col("home").alias("a"), F.col("id").alias("b"))
    least = places.join(home, ["grp", *CELL]).select("grp", "id", "lat", "lng", "eps", "home")
    pairs = near_pairs(least, least).join(least.select(F.col("id").alias("a"), F.col("home").alias("home_a")), "a").join(least.select(F.col("id").alias("b"), F.col("home").alias("home_b")), "b")
    between = pairs.filter("home_a < home_b").groupBy("home_a", "home_b").count().select(F.col("home_a").alias("a"), F.col("home_b").alias("b"))
    return inside.unionByName(between)


def _first_radius(places: DataFrame) -> DataFrame:
    """(grp, km): a radius for each group at which its densest cell holds few places."""
    wide = (F.max("lat") - F.min("lat")) * (F.max("lng") - F.min("lng")) * F.lit(KM_PER_DEGREE**2)
    start = places.groupBy("grp").agg(F.greatest(F.lit(0.001), F.sqrt(wide / F.count("*"))).alias("km"))
    for _ in range(12):
        crowd = _cells(places.join(start, "grp"), _chord(F.col("km")), False).groupBy("grp", *CELL).count().groupBy("grp").agg(F.max("count").alias("most"))
        tight = start.join(crowd, "grp").select("grp", F.when((F.col("most") > CROWD) & (F.col("km") > 0.001), F.col("km") / 4).otherwise(F.col("km")).alias("km"), (F.col("most") > CROWD).alias("more"))
        tight = staged(tight, "radius")
        start = tight.select("grp", "km")
        if tight.filter("more AND km > 0.001").isEmpty():
            break
    return start


def nearest_distances(points: DataFrame) -> DataFrame:
    """(grp, id, nn) the distance to the nearest other point of the group, null for one alone.

    Points at one place are at distance 0. The other places come to cells of growing size, from one that is small where the
    group is dense, until each has another place within the size of its cell: a lonely one costs a few more rounds, a
    dense city none.
    """
    points = staged(points.select("grp", "id", "lat", "lng"), "points")
    places = staged(points.groupBy("grp", "lat", "lng").agg(F.min("id").alias("id"), F.count("*").alias("n")), "places")
    start = _first_radius(places)
    every = places.select("grp", "id", "lat", "lng")
    rest, done, factor = staged(places.filter("n = 1").join(start, "grp").select("grp", "id", "lat", "lng", "km"), "nearest"), None, 1.0
    while not rest.isEmpty():
        asking = rest.select("grp", "id", "lat", "lng", F.least(F.col("km") * factor, F.lit(20_100.0)).alias("eps"))
        there = every.join(asking.select("grp", "eps").distinct(), "grp")
        pairs = near_pairs(asking, there)
        found = pairs.groupBy("grp", F.col("a").alias("id")).agg(F.min("km").alias("nn"))
        step = staged(rest.join(found, ["grp", "id"], "left"), "nearest")
        hit = step.filter("nn is not null OR km * %r > 20100" % factor).select("grp", "id", "nn")
        done = hit if done is None else done.unionByName(hit)
        rest = step.filter("nn is null AND km * %r <= 20100" % factor).drop("nn")
        factor *= 4
    same = points.join(places.filter("n > 1").select("grp", "lat", "lng"), ["grp", "lat", "lng"]).select("grp", "id", F.lit(0.0).alias("nn"))
    return same if done is None else done.unionByName(same)


def adaptive_eps(points: DataFrame, share: float = 0.15, low: float = 0.5, high: float = 50.0, small: float = 8.0) -> DataFrame:
    """(grp, n, eps): the nearest-neighbour distance at place floor(n * share) of the sorted ones, within low and high; small for fewer than 3 points."""
    n = points.groupBy("grp").agg(F.count("*").alias("n"))
    near = staged(nearest_distances(points).filter("nn is not null").select("grp", "nn"), "distances")
    at = order_statistic(near, "nn", n.filter("n > 2").select("grp", F.floor(F.col("n") * share).alias("place"))).withColumnRenamed("value", "eps0")
    return n.join(at, "grp", "left").select("grp", "n", F.when(F.col("n") < 3, small).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.col("eps0")))).alias("eps"))


def order_statistic(rows: DataFrame, column: str, places: DataFrame) -> DataFrame:
    """(grp, value): the value of rows (grp, column) at a place of each group's sorted ones, from 0; places are (grp, place).

    No group is sorted: values are counted in bins between a group's least and greatest, the bin that holds the place is
    divided again, until it holds one value. A round shuffles BINS counts a group at most from each task. Groups whose place
    lies beyond their values give no row.
    """
    rows = rows.select("grp", F.col(column).cast("double").alias("value"))
    ranges = rows.groupBy("grp").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("size"))
    open_, done = staged(ranges.join(places, "grp").filter("place < size").select("grp", "lo", "hi", "place"), "ranges"), None
    while True:
        hit = open_.filter("lo = hi").select("grp", F.col("lo").alias("value"))
        done = hit if done is None else done.unionByName(hit)
        wide = open_.filter("lo < hi")
        if wide.isEmpty():
            return done
        share = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        bins = rows.join(wide, "grp").filter("value BETWEEN lo AND hi").withColumn("bin", F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        counts = bins.groupBy("grp", "bin").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("size"), F.first("place").alias("place"))
        upto = F.sum("size").over(Window.partitionBy("grp").orderBy("bin"))  # BINS rows at most
        holds = counts.withColumn("before", upto - F.col("size")).filter("place >= before AND place < before + size")
        open_ = staged(holds.select("grp", "lo", "hi", (F.col("place") - F.col("before")).alias("place")), "ranges")


def clusters(points: DataFrame) -> DataFrame:
    """(id, grp, cluster): density clusters with at least two points, by the group's own radius; noise and groups of up to two points have none.

    With two points for a core there are no border points, so clusters are the components of the neighbour graph.
    """
    eps = adaptive_eps(points)
    near = links_within(points.join(eps.filter("n > 2").select("grp", "eps"), "grp"))
    named = connected_components(near).select("id", F.col("component").alias("cluster"))
    return points.select("id", "grp").join(named, "id", "left")


def summary(points: DataFrame, labelled: DataFrame) -> DataFrame:
    """Centroid, radius and size of each cluster."""
    rows = points.join(labelled.filter("cluster is not null").select("id", "cluster"), "id")
    centre = rows.groupBy("cluster").agg(F.avg("lat").alias("centroid_lat"), F.avg("lng").alias("centroid_lng"), F.count("*").alias("n"), F.first("grp").alias("grp"))
    far = rows.join(centre, "cluster").groupBy("cluster").agg(F.max(haversine(F.col("lat"), F.col("lng"), F.col("centroid_lat"), F.col("centroid_lng"))).alias("radius"))
    return centre.join(far, "cluster").select("cluster", "grp", "centroid_lat", "centroid_lng", "radius", F.col("n").alias("point_count"))


def representatives(points: DataFrame, labelled: DataFrame) -> DataFrame:
    """(key, grp, lat, lng): the centroid of each cluster as c-id, and each point outside one as p-id."""
    groups = summary(points, labelled).select(F.concat(F.lit("c-"), "cluster").alias("key"), "grp", F.col("centroid_lat").alias("lat"), F.col("centroid_lng").alias("lng"))
    alone = points.join(labelled.filter("cluster is null").select("id"), "id").select(F.concat(F.lit("p-"), "id").alias("key"), "grp", "lat", "lng")
    return groups.unionByName(alone)


def nearest_of(points: DataFrame, sites: DataFrame) -> DataFrame:
    """(id, nearest, km): each point with the key of the nearest site (part, key, ord, lat, lng) of its part, the first by ord of equals.

    Sites come to cells of growing size, from one at which the part's densest cell holds few of them, so no point meets all
    sites of its part. Points that lie at one place ask once. Points of parts without sites give no row.
    """
    sites = staged(sites.select(F.col("part").alias("grp"), F.struct("ord", "key").alias("id"), "lat", "lng").filter("lat is not null and lng is not null"), "sites")
    start = _first_radius(sites)
    points = points.select("id", F.col("part").alias("grp"), "lat", "lng").filter("lat is not null and lng is not null")
    places = points.groupBy("grp", "lat", "lng").count().select("grp", F.struct("lat", "lng").alias("id"), "lat", "lng")
    rest = staged(places.join(start, "grp"), "nearest")
    done, factor = None, 4.0
    while True:
        asking = rest.select("grp", "id", "lat", "lng", F.least(F.col("km") * factor, F.lit(20_100.0)).alias("eps"))
        pairs = near_pairs(asking, sites.join(asking.select("grp", "eps").distinct(), "grp"), others=False)
        best = F.min(F.struct("km", "b")).alias("best")
        step = staged(rest.join(pairs.groupBy("grp", F.col("a").alias("id")).agg(best), ["grp", "id"], "left"), "nearest")
        hit = step.filter("best is not null").select("grp", "lat", "lng", F.col("best.b.key").alias("nearest"), F.round("best.km", 6).alias("km"))
        done = hit if done is None else done.unionByName(hit)
        rest = step.filter("best is null").drop("best")
        if rest.isEmpty():
            return points.join(done, ["grp", "lat", "lng"]).select("id", "nearest", "km")
        factor *= 4


def nearest_in_plane(points: DataFrame, sites: DataFrame, first: float = 0.25) -> DataFrame:
    """(id, key) of the nearest site (key, x, y) of each point (id, x, y), distances to 9 decimals, ties to the least key.

    Points and sites meet in square cells of growing side, so no point meets all sites; a site within the side is the nearest.
    """
    wide = sites.agg(F.max("x"), F.min("x"), F.max("y"), F.min("y")).union(points.agg(F.max("x"), F.min("x"), F.max("y"), F.min("y"))).collect()  # two rows
    spans = [[v for row in wide for v in row[k : k + 2] if v is not None] for k in (0, 2)]
    reach = sum(max(v) - min(v) for v in spans) if all(spans) else 0.0
    rest, done, side = points.select("id", "x", "y"), None, first
    while True:
        at = lambda c, side=side: F.floor(F.col(c) / side)
        asks = rest.withColumn("i", F.explode(F.array(at("x") - 1, at("x"), at("x") + 1))).withColumn("j", F.explode(F.array(at("y") - 1, at("y"), at("y") + 1)))
        there = sites.select("key", F.col("x").alias("sx"), F.col("y").alias("sy"), at("x").alias("i"), at("y").alias("j"))
        d = F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2)
        found = asks.join(there, ["i", "j"]).filter(d <= side**2).groupBy("id").agg(F.min_by("key", F.struct(F.round(d, 9), F.col("key"))).alias("key"))
        step = staged(rest.join(found, "id", "left"), "nearest")
        hit = step.filter("key is not null").select("id", "key")
        done = hit if done is None else done.unionByName(hit)
        rest = step.filter("key is null").drop("key")
        if side > reach or rest.isEmpty():
            return done
        side *= 4


def redistribute(rows: DataFrame) -> DataFrame:
    """rows (id, grp, jurisdiction, lat, lng, ...) with the rows of catch-all groups moved to the nearest real group.

    A catch-all is named as a jurisdiction that has other groups; a group is of the jurisdiction of its row of the least id,
    and centroids are those before any row moves. Other groups stay; a group that is dissolved itself takes no rows.
    """
    first = F.min_by(F.coalesce("jurisdiction", F.lit("")), "id").alias("part")
    groups = rows.groupBy(F.col("grp").alias("key")).agg(first, F.min("id").alias("ord"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
    real = groups.filter("key <> part")
    sites = real.join(real.select(F.col("part").alias("key")).distinct(), "key", "left_anti")
    moved = nearest_of(rows.select("id", F.col("grp").alias("part"), "lat", "lng"), sites).select("id", "nearest")
    return rows.join(moved, "id", "left").withColumn("grp", F.coalesce("nearest", "grp")).drop("nearest").select(rows.columns)


def closest(points: DataFrame, lat: float, lng: float, k: int = 10, words: Column | None = None) -> DataFrame:
    """The k points nearest to a place in miles, of those that words selects, or of all if it selects none; filtered tells which."""
    miles = haversine(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"), MILES)
    ranked = points.filter("lat is not null and lng is not null").withColumn("miles", miles)
    if words is None:
        return ranked.orderBy("miles", "id").limit(k).withColumn("filtered", F.lit(False))
    hit = ranked.filter(words).orderBy("miles", "id").limit(k).withColumn("filtered", F.lit(True))
    rest = ranked.orderBy("miles", "id").limit(k).withColumn("filtered", F.lit(False))
    both = hit.unionByName(rest)  # 2k rows
    return both.withColumn("any", F.max("filtered").over(Window.partitionBy(F.lit(1)))).filter("filtered = any").drop("any")

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from atlasweave.operators import polygons, spatial


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 6371 * 2 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


def table(spark, n=160):
    rng = random.Random(9)
    rows = [(k, k % 3, 60 + rng.random() * 8, 10 + rng.random() * 10) for k in range(n)]
    rows += [(900, 7, 1.0, 1.0), (901, 8, 0.0, 0.0), (902, 8, 0.0, 0.001)]
    return rows, spark.createDataFrame(rows, "id long, grp long, lat double, lng double")


def test_clusters_against_brute_force(spark):
    rows, df = table(spark)
    want = {}
    for g in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == g]
        at = {r[0]: (r[3], r[2]) for r in own}
        nearest = sorted(min((km(at[a], at[b]) for b in at if b != a), default=math.inf) for a in at)
        eps = 8.0 if len(own) < 3 else max(0.5, min(50.0, nearest[int(len(own) * 0.15)]))
        label = {a: a for a in at}
        changed = len(own) > 2
        while changed:
            changed = False
            for a in at:
                for b in at:
                    if km(at[a], at[b]) <= eps and label[b] < label[a]:
                        label[a], changed = label[b], True
        sizes = {v: list(label.values()).count(v) for v in label.values()}
        want |= {a: (label[a] if sizes[label[a]] > 1 else None) for a in at}
    got = {r.id: r.cluster for r in spatial.clusters(df).collect()}
    assert got == want
    assert any(v is not None for v in want.values())


def test_whole_sphere_against_brute_force(spark):
    """Points on both sides of 180 degrees, at the poles, antipodes, and across the globe."""
    rng = random.Random(4)
    rows = [(k, 0, (rng.random() - 0.5) * 20, (180 + (rng.random() - 0.5) * 4 + 180) % 360 - 180) for k in range(80)]
    rows += [(100 + k, 1, 89.9 + rng.random() * 0.1, rng.random() * 360 - 180) for k in range(80)] + [(190, 1, 90.0, 0.0), (191, 1, -90.0, 0.0), (192, 1, -89.99, 120.0)]
    rows += [(200, 2, 0.0, 179.999), (201, 2, 0.0, -179.999), (202, 2, 0.0, 179.0), (203, 2, 0.0, -178.0), (300, 3, 10.0, 20.0), (301, 3, -10.0, -160.0)]
    df = spark.createDataFrame(rows, "id long, grp long, lat double, lng double")
    own = lambda r: [(km((r[3], r[2]), (x[3], x[2])), x[0]) for x in rows if x[1] == r[1] and x[0] != r[0]]
    got = {r.id: r.nn for r in spatial.nearest_distances(df).collect()}
    assert all(abs(got[r[0]] - min(own(r))[0]) < 1e-6 for r in rows) and len(got) == len(rows)
    for eps in (0.3, 30.0, 400.0, 12_000.0, 20_015.0):
        pairs = {(r.a, r.b) for r in spatial.neighbours(df.withColumn("eps", F.lit(eps))).collect()}
        assert pairs == {(r[0], k) for r in rows for d, k in own(r) if d <= eps}
        label = {r[0]: r[0] for r in rows}
        changed = True
        while changed:
            changed = False
            for a, b in pairs:
                if label[b] < label[a]:
                    label[a], changed = label[b], True
        links = spatial.links_within(df.withColumn("eps", F.lit(eps))).collect()
        parent = {r[0]: r[0] for r in rows}
        changed = True
        while changed:
            changed = False
            for x in links:
                low = min(parent[x.a], parent[x.b])
                if parent[x.a] != low or parent[x.b] != low:
                    parent[x.a] = parent[x.b] = low
                    changed = True
        assert parent == label


def test_order_statistics(spark):
    rng = random.Random(5)
    values = {0: [rng.random() ** 9 * 1e6 for _ in range(500)], 1: [1.0] * 300 + [2.0], 2: [0.0, 5e-324, 1e308], 3: [rng.choice([0.1, 0.1 + 1e-16, 0.1 + 2e-16, 7.0]) for _ in range(99)]}
    rows = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "grp long, v double")
    places = [(0, 75), (1, 300), (2, 1), (3, 50), (9, 0)]
    got = spatial.order_statistic(rows, "v", spark.createDataFrame(places, "grp long, place long")).collect()
    assert {r.grp: r.value for r in got} == {g: sorted(values[g])[k] for g, k in places if g in values} and len(got) == 4


def test_nearest_sites_against_all(spark):
    rng = random.Random(8)
    sites = [(rng.choice("ab"), f"s{k}", k, (rng.random() - 0.5) * 179, (rng.random() - 0.5) * 360) for k in range(60)] + [("a", "twin", -1, 3.0, 180.0), ("a", "also", 99, 3.0, -180.0)]
    sites += [("b", f"d{k}", 100 + k, 50 + rng.random() * 0.01, rng.random() * 0.01) for k in range(150)]
    points = [(k, rng.choice("abc"), (rng.random() - 0.5) * 180, (rng.random() - 0.5) * 360) for k in range(150)] + [(500, "a", 3.0, 179.99), (501, "b", None, 1.0)]
    got = spatial.nearest_of(spark.createDataFrame(points, "id long, part string, lat double, lng double"), spark.createDataFrame(sites, "part string, key string, ord long, lat double, lng double")).collect()
    want = {i: min((km((lng, lat), (y, x)), o, k) for p, k, o, x, y in sites if p == part)[2] for i, part, lat, lng in points if part != "c" and lat is not None}
    assert {r.id: r.nearest for r in got} == want and want[500] == "twin" and len(got) == len(want)


def test_closest_falls_back(spark):
    _, df = table(spark)
    assert [r.filtered for r in spatial.closest(df, 64.0, 15.0, 3, F.col("grp") == 1).collect()] == [True] * 3
    rows = spatial.closest(df, 64.0, 15.0, 3, F.col("grp") == 99).collect()
    assert [r.filtered for r in rows] == [False] * 3


def test_orphans_come_to_the_nearest_group_of_their_jurisdiction(spark):
    rows = [(1, "A east", "A", 10.0, 20.0), (2, "A west", "A", 10.0, 0.0), (3, "A", "A", 10.0, 19.0), (4, "A", "A", 10.0, 1.0), (5, "A", "A", 10.0, 10.0)]
    rows += [(6, "B near", "B", 10.0, 18.9), (7, "C", "C", 10.0, 18.0), (8, "B near", "A", 10.0, 19.0), (9, "none", None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, grp string, jurisdiction string, lat double, lng double")
    got = {r.id: r.grp for r in spatial.redistribute(df).collect()}
    assert got == {1: "A east", 2: "A west", 3: "A east", 4: "A west", 5: "A east", 6: "B near", 7: "C", 8: "B near", 9: "none"}


def inside(ring, p):
    return all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= -1e-9 for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def test_hulls_and_cells(spark):
    rows, df = table(spark)
    box = (0.0, 50.0, 30.0, 80.0)
    at = {r[0]: (r[3], r[2]) for r in rows}
    for r in polygons.hulls(df, buffer_km=30).collect():
        assert all(inside(r.ring, at[x[0]]) for x in rows if x[1] == r.grp)
    some = df.filter("grp < 3")
    for r in polygons.concave_hulls(some, 1.0).collect():
        assert 0 < polygons.area([r.ring])[0] <= polygons.area([polygons._ring(polygons.convex_hull(np.array([at[x[0]] for x in rows if x[1] == r.grp])))])[0] + 1e-9


def test_one_diagram_tiles_the_box(spark):
    """Cells of a dense city, of lonely sites and of one at a city's place."""
    rng = random.Random(3)
    at = {k: (rng.random() * 30, 50 + rng.random() * 30) for k in range(60)} | {100 + k: (10 + rng.random() * 0.01, 60 + rng.random() * 0.01) for k in range(60)}
    at[500] = at[100]
    df = spark.createDataFrame([(k, y, x) for k, (x, y) in at.items()], "id long, lat double, lng double")
    box = (0.0, 50.0, 30.0, 80.0)
    rings = {r.id: r.ring for r in polygons.voronoi(df, box).collect()}
    assert set(rings) == set(at)
    twin = rings.pop(500)  # a disc of half a kilometre
    assert len(twin) == 32 and all(abs(km(p, at[500]) - 0.5) < 0.01 for p in twin)
    assert all(inside(r, at[k]) for k, r in rings.items())
    assert abs(sum(polygons.area(list(rings.values()))) - 900) < 1e-6
    every = np.array([at[k] for k in rings])
    for k, r in rings.items():
        want = polygons.cell(np.array(at[k]), every, box)
        assert abs(polygons.area([r])[0] - polygons.area([polygons._ring(want)])[0]) < 1e-9
    one = polygons.voronoi(df.filter("id = 3"), box).first().ring
    assert polygons.area([one])[0] == 900


def test_outlines_cover_their_points(spark):
    rows, df = table(spark)
    more = spark.createDataFrame([(1000 + k, 9, 40.0, 10.0 + k / 10) for k in range(5)], "id long, grp long, lat double, lng double")  # in a line
    at = {r[0]: (r[3], r[2], r[1]) for r in rows} | {1000 + k: (10.0 + k / 10, 40.0, 9) for k in range(5)}
    found = {r.grp: r.rings for r in polygons.outlines(df.unionByName(more), longest_km=120.0).collect()}
    assert set(found) == {0, 1, 2, 7, 8, 9} and len(found[7]) == len(found[8]) == len(found[9]) == 1 and len(found[0]) > 1
    for x, y, g in at.values():
        bands = [r for r in found[g][1:] or found[g]]
        ring = np.array(found[g][0])
        crossings = sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, np.roll(ring, -1, axis=0), strict=True))
        assert crossings % 2 or any(inside(b, (x, y)) for b in bands)


def test_nearest_in_plane_against_all(spark):
    rng = random.Random(6)
    sites = [(k, rng.random() * 40, rng.random() * 3) for k in range(30)]
    points = [(k, rng.random() * 50 - 5, rng.random() * 9 - 3) for k in range(200)]
    want = {i: min((round((x - a) ** 2 + (y - b) ** 2, 9), k) for k, a, b in sites)[1] for i, x, y in points}
    got = spatial.nearest_in_plane(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(sites, "key long, x double, y double"))
    assert {r.id: r.key for r in got.collect()} == want
    assert spatial.nearest_in_plane(got.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), spark.createDataFrame([], "key long, x double, y double")).count() == 0


def test_dense_places(spark):
    """Many points at one place and in one city: distances and clusters as by hand."""
    rng = random.Random(7)
    rows = [(k, 0, 40.0, 10.0) for k in range(200)] + [(200 + k, 0, 40 + rng.random() * 0.002, 10 + rng.random() * 0.002) for k in range(200)] + [(900, 0, 41.0, 10.0), (901, 0, 60.0, 100.0)]
    df = spark.createDataFrame(rows, "id long, grp long, lat double, lng double")
    got = {r.id: r.nn for r in spatial.nearest_distances(df).collect()}
    at = {r[0]: (r[3], r[2]) for r in rows}
    for k in (0, 5, 200, 333, 900, 901):
        assert abs(got[k] - min(km(at[k], at[j]) for j in at if j != k)) < 1e-9
    labels = {r.id: r.cluster for r in spatial.clusters(df).collect()}
    assert {labels[k] for k in range(400)} == {0} and labels[900] is None and labels[901] is None


def test_points_at_one_place_ask_once(spark, monkeypatch):
    asked, near_pairs = [], spatial.near_pairs
    monkeypatch.setattr(spatial, "near_pairs", lambda asking, *more, **named: asked.append(asking.count()) or near_pairs(asking, *more, **named))
    points = spark.range(300).select("id", F.lit("p").alias("part"), (F.col("id") % 3).cast("double").alias("lat"), F.lit(5.0).alias("lng"))
    points = points.unionByName(spark.createDataFrame([(900, "p", None, 1.0), (901, "q", 0.0, 0.0)], "id long, part string, lat double, lng double"))
    sites = spark.createDataFrame([("p", "a", 2, 0.1, 5.0), ("p", "b", 1, 1.9, 5.0)], "part string, key string, ord long, lat double, lng double")
    got = {r.id: r.nearest for r in spatial.nearest_of(points, sites).collect()}
    assert got == {k: "ab"[(k % 3) > 0] if k % 3 != 1 else "b" for k in range(300)}  # the middle is as far from both: the first by ord
    assert max(asked) <= 3


def test_outlines_call_python_once_for_many_cells(spark):
    points = spark.range(3000).select("id", (F.col("id") % 2).alias("grp"), F.rand(1).alias("lat"), F.rand(2).alias("lng"))
    made = polygons.outlines(points)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1
    rows = spark.range(3000).select((F.col("id") % 2).alias("grp"), (F.col("id") % 5).alias("i"), F.rand(1).alias("lat"), F.rand(2).alias("lng"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # a run goes on over many batches
    try:
        got = sorted(map(tuple, polygons._corners(rows, "i").select("grp", "i", "lng", "lat").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    cells = {}
    for r in rows.collect():
        cells.setdefault((r.grp, r.i), []).append((r.lng, r.lat))
    assert got == sorted((*k, *map(float, p)) for k, v in cells.items() for p in polygons.convex_hull(np.array(v)))


def test_first_side_of_crowded_sites(spark):
    sites = spark.range(400).select("id", F.when(F.col("id") < 300, F.rand(3) / 50).otherwise(F.rand(3) * 9).alias("lng"), F.when(F.col("id") < 300, F.rand(4) / 50).otherwise(F.rand(4) * 9).alias("lat"))
    side = polygons._first_side(sites)
    assert sites.groupBy(F.floor(F.col("lng") / side), F.floor(F.col("lat") / side)).count().agg(F.max("count")).first()[0] <= polygons.CROWD
    cells = {r.id: r.ring for r in polygons.voronoi(sites, (0.0, 0.0, 9.0, 9.0)).collect()}
    assert len(cells) == 400 and abs(sum(polygons.area([r])[0] for r in cells.values()) - 81) < 1e-6


def turn(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def dug(points, ring, longest):
    """The ring that concave_ring digs, by trying all points and edges; exact for whole numbers."""
    on = lambda p, u, v: turn(u, v, p) == 0 and (p[0] - u[0]) * (p[0] - v[0]) + (p[1] - u[1]) * (p[1] - v[1]) < 0
    sides = lambda u, v, p, q: turn(u, v, p) < 0 < turn(u, v, q) or turn(u, v, q) < 0 < turn(u, v, p)
    meet = lambda a, b, c, d: sides(a, b, c, d) and sides(c, d, a, b) or on(a, c, d) or on(b, c, d) or on(c, a, b) or on(d, a, b)
    i = 0
    while i < len(ring):
        a, b = ring[i], ring[(i + 1) % len(ring)]
        others = [(c, d) for c, d in zip(ring, ring[1:] + ring[:1], strict=True) if (c, d) != (a, b)]
        far = {p: max(math.dist(a, p), math.dist(p, b)) for p in points if p not in ring}
        able = [p for p in far if turn(a, b, p) >= 0 and math.dist(a, b) > max(far[p], longest)]
        able = [p for p in able if turn(a, b, p) == 0 or not any(min(turn(a, b, q), turn(b, p, q), turn(p, a, q)) >= 0 for q in points - {a, b, p})]
        able = [p for p in able if not any(meet(a, p, c, d) or meet(p, b, c, d) for c, d in others)]
        if able:
            ring = [*ring[: i + 1], min(able, key=lambda p: (far[p], p)), *ring[i + 1 :]]
        else:
            i += 1
    return ring


def test_outlines_take_in_a_point_behind_many_nearer_ones(spark):
    """The only point that an edge can take in is the ninety-first by distance: each triangle with a nearer one holds it."""
    places = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (1.0, 0.01)] + [(4.5 + x / 9, 3 + y / 9) for x in range(9) for y in range(10)]
    df = spark.createDataFrame([(k, 1, y, x) for k, (x, y) in enumerate(places)], "id long, grp long, lat double, lng double")
    for ring in (polygons.outlines(df).first().rings[0], polygons.concave_hulls(df, 300 / 111).first().ring):
        k = ring.index([0.0, 0.0])
        assert [*ring, *ring][k + 1] == [1.0, 0.01] and [4.5 + 8 / 9, 3.0] in ring


def test_concave_rings_against_all_points():
    """Points on a grid, so that many lie in a line; of half of the sets a bay is left empty."""
    rng, more = random.Random(11), 0
    for k in range(150):
        wide = rng.choice([4, 9, 40])
        points = {(rng.randrange(wide), rng.randrange(wide)) for _ in range(rng.choice([8, 30, 90]))}
        points = {p for p in points if k % 2 or not (wide * 0.3 < p[0] < wide * 0.7 and p[1] > wide * 0.3)}
        hull = [(int(x), int(y)) for x, y in polygons.convex_hull(np.array(sorted(points), float))]
        longest = rng.choice([0.5, 1.5, wide / 4])
        got = [tuple(p) for p in polygons.concave_ring(np.array(sorted(points), float), longest).tolist()]
        assert got == dug(points, hull, longest)
        more += len(got) > len(hull)
    assert more > 100


def test_concave_rings_leave_no_point_outside():
    """Points that are in a line but for rounding."""
    rng = random.Random(12)
    for k in range(60):
        step, turned = rng.choice([0.1, 1 / 111, 0.7]), rng.choice([0.0, 0.3, 1.0])
        at = np.array([(rng.randrange(15) * step, rng.randrange(15) * step) for _ in range(90)])
        at = at @ np.array([[math.cos(turned), math.sin(turned)], [-math.sin(turned), math.cos(turned)]]) + (-95, 45)
        a = polygons.concave_ring(at, step * (k % 6 + 0.5))
        b = np.roll(a, -1, axis=0)
        for x, y in at:
            crossings = sum(((a[:, 1] > y) != (b[:, 1] > y)) & (x < (b - a)[:, 0] * (y - a[:, 1]) / np.where(b[:, 1] == a[:, 1], 1, b[:, 1] - a[:, 1]) + a[:, 0]))
            t = np.clip((((x, y) - a) * (b - a)).sum(1) / ((b - a) ** 2).sum(1), 0, 1)
            assert crossings % 2 or np.hypot(*(a + t[:, None] * (b - a) - (x, y)).T).min() < 1e-9

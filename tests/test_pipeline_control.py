from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from atlasweave.functions.clergy import clergy
from atlasweave.operators import cleaning, output
from atlasweave.plans.pipeline import Lookups, Pipeline, Store, directory_build, directory_pipeline, duration, folder_fingerprint, table_fingerprint
from atlasweave.sources import files
from atlasweave.streaming import visits


def three():
    return Pipeline({"a": lambda d: d.withColumn("a", F.lit(1)), "b": lambda d: d.withColumn("b", F.lit(2)), "serve": lambda d: d})


def test_choice():
    p = three()
    assert p.choose() == ["a", "b"]
    assert p.choose(only="serve") == ["serve"]
    assert p.choose(stages=["serve", "a"]) == ["a", "serve"]
    assert p.choose(start="b") == ["b"]
    assert p.choose(skip=["a"]) == ["b"]
    with pytest.raises(ValueError):
        p.choose(only="x")


def test_run_and_report(spark):
    p = three()
    assert p.run(spark.range(1), p.choose()).columns == ["id", "a", "b"]
    p.stages["b"] = lambda d: d.select("missing")
    with pytest.raises(RuntimeError, match="resume with start='b'"):
        p.run(spark.range(1), p.choose())
    p.run(spark.range(1), ["a"], dry=True)
    assert [r.status for r in p.report(spark).collect()] == ["done", "done", "done", "failed", "listed"]
    took = [r.t for r in spark.createDataFrame([(0.25,), (12.34,), (125.0,)], "s double").select(duration(F.col("s")).alias("t")).collect()]
    assert took == ["250ms", "12.3s", "2m 5s"]


def test_records_are_cleaned_before_they_merge(spark):
    raw = [(1, "\"St.  Mark\"", "", "Palm  Coast, Florida", "", "3125550147", "WWW.Foo.ORG/", "41.881832199", "-87.5", "oca"), (2, "St. Mark (www)", None, "Palm Coast", "fl", "", "", "91", "x", "goarch")]
    df = spark.createDataFrame(raw, "ord long, name string, jurisdiction string, city string, state string, phone string, website string, lat string, lng string, source string")
    p = directory_pipeline()
    clean = {r.ord: r for r in p.run(df, ["clean"]).collect()}
    assert [clean[1][c] for c in ("name", "jurisdiction", "city", "state", "country", "phone", "website", "lat", "lng", "zip", "clergy")] == [
        "St. Mark", "Orthodox Church in America (OCA)", "Palm Coast", "FL", "USA", "(312) 555-0147", "https://www.foo.org", "41.8818322", "-87.5", "", ""]
    assert (clean[2].name, clean[2].state, clean[2].lat, clean[2].lng) == ("St. Mark", "FL", "", "")
    rows = p.run(df, p.choose()).collect()
    assert [(r.name, r.city, r.phone) for r in rows] == [("St. Mark", "Palm Coast", "(312) 555-0147")]


def test_the_plan_of_a_clean_record_stays_small(spark):
    def leaves(e):
        below = [e.children().apply(i) for i in range(e.children().size())]
        return sum(map(leaves, below)) if below else 1

    df = spark.createDataFrame([("A", "1")], "name string, extra string")
    rows = cleaning.clean_record(df).filter("name <> '' AND city = 'x' AND state = 'NY'")
    node, total = rows._jdf.queryExecution().optimizedPlan(), 0
    while True:
        made = node.expressions()
        total += sum(leaves(made.apply(i)) for i in range(made.size()))
        if not node.children().size():
            break
        node = node.children().apply(0)
    assert total < 3000
    assert cleaning.clean_record(df).first().asDict()["extra"] == "1"


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"parish": "A", "lat": 1.5, "detailUrl": "/x", "extra": 3}, {"name": "B", "source": "oca"}]')
    rows = files.read_json(spark, str(tmp_path / "a.json"), "goarch", 0).orderBy("name").collect()
    assert [(r.name, r.source, r.lat, r.website) for r in rows] == [("A", "goarch", "1.5", "/x"), ("B", "oca", None, None)]
    both = files.union_all([spark.range(1), spark.range(1).withColumn("x", F.lit(1))])
    assert both.columns == ["id", "x"] and both.count() == 2
    files.write_csv(both, str(tmp_path / "csv"))
    files.write_json(both, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_sources_pages_and_references(spark, tmp_path):
    (tmp_path / "oca.json").write_text('[{"name": "A", "detailUrl": "/1"}, {"name": "Z", "detailUrl": "/1"}, {"title": "B"}]')
    (tmp_path / "goarch.json").write_text('[{"parish_name": "C", "telephone": "1", "latitude": "2", "address1": "x", "address2": "y", "stateProvince": "NY"}]')
    (tmp_path / "acrod.json").write_text("[{broken")
    (tmp_path / "all-parishes.json").write_text("[]")
    rows = files.read_sources(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.name, r.source, r.phone, r.lat, r.address, r.state) for r in rows] == [("A", "oca", None, None, None, None), ("B", "oca", None, None, None, None), ("C", "goarch", "1", "2", "x, y", "NY")]
    assert files.read_sources(spark, str(tmp_path / "none")).count() == 0
    assert sorted(r.source for r in files.listing(spark, str(tmp_path)).collect()) == ["acrod", "goarch", "oca"]
    assert [r.name for r in files.inline(spark, [{"name": "K"}, {"parish": "L"}], "s").collect()] == ["K", "L"]
    assert files.merged_if_several({"a": spark.range(1)}) is None and files.merged_if_several({"a": spark.range(1), "b": spark.range(2)}).count() == 3
    assert [r.id for r in files.capped(spark.range(9), "id", 2).collect()] == [0, 1]
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "p.html").write_text("<p>a</p>\n<p>b</p>")
    (page,) = files.read_pages(spark, str(pages)).collect()
    assert page.url.endswith("/p.html") and page.html == "<p>a</p>\n<p>b</p>"
    for k, body in enumerate(('[{"name": "A"}]', '{"data": [{"name": "B"}]}', '{"results": [{"name": "C"}]}', "{}", "x")):
        (tmp_path / f"e{k}").write_text(body)
        assert [r.name for r in files.read_enveloped(spark, str(tmp_path / f"e{k}"), "s").collect()] == list("ABC")[k : k + 1]
    (tmp_path / "h").write_text('{"P": ["a", "b"], "Q": ["a"]}')
    assert [(r.parent, r.child) for r in files.read_hierarchy(spark, str(tmp_path / "h")).orderBy("ord").collect()] == [("P", "a"), ("P", "b"), ("Q", "a")]
    (tmp_path / "r").write_text('{"D": {"jurisdiction": "J", "region": "R", "states": ["NY"], "bishop": "B"}, "E": {"jurisdiction": "J", "states": []}}')
    assert [(r.entry, r.parent, r.areas, r.bishop) for r in files.read_registry(spark, str(tmp_path / "r")).orderBy("ord").collect()] == [("D", "J", ["NY"], "B"), ("E", "J", [], None)]
    (tmp_path / "s").write_text('{"bishopLocations": {"D": {"seat": "Town, NY", "type": "see"}}}')
    assert [(r.diocese, r.seat, r.type) for r in files.read_seats(spark, str(tmp_path / "s")).collect()] == [("D", "Town, NY", "see")]


def test_whole_build(spark, tmp_path):
    goa = [{"name": f"St. {k}", "city": "Town", "state": "NY", "lat": str(40 + k * 0.01), "lng": "-74", "jurisdiction": "goa"} for k in range(1, 7)]
    (tmp_path / "goarch.json").write_text(json.dumps([*goa, {"name": "No Place", "city": "Far", "state": "NY", "address": "1 Main"}]))
    (tmp_path / "assembly-of-bishops.json").write_text(json.dumps([{"name": "St. 1", "city": "Town", "phone": "3125550147", "jurisdiction": "Greek Orthodox"}, {"name": "Lone", "lat": "30", "lng": "-90", "jurisdiction": "x"}]))
    lookups = Lookups(
        spark.createDataFrame([("P", "Greek Orthodox Archdiocese of America", 0)], "parent string, child string, ord int"),
        spark.createDataFrame([("Metropolis", 0, "Greek Orthodox Archdiocese of America", "R", ["NY"], "Bishop B")], "entry string, ord int, parent string, region string, areas array<string>, bishop string"),
        spark.createDataFrame([("Town, NY", "Metropolis", "see", 0)], "seat string, diocese string, type string, ord int"),
        spark.createDataFrame([("1 Main, Far, NY, USA", 41.0, -75.0)], "place string, lat double, lng double"),
    )
    out = str(tmp_path / "out")
    build = directory_build(spark, str(tmp_path), lookups, out, box=(-100.0, 20.0, -60.0, 50.0))
    assert list(build.stages) == ["scrape", "dedup", "enrich", "geocode", "import", "compute", "snapshot", "serve"]
    tables = build.run({}, [*build.choose(), "serve"])
    records = {r.name: r for r in tables["records"].collect()}
    assert len(records) == 8 and records["St. 1"].phone == "(312) 555-0147" and records["St. 1"].source == "assembly-of-bishops, goarch"
    assert (records["No Place"].lat, records["No Place"].lng) == (41.0, -75.0) and {r.diocese for r in records.values()} == {"Metropolis", ""}
    kinds = {(r.tier, r.diocese) for r in tables["polygons"].collect()}
    assert (1, "Metropolis") in kinds and (1, "x") in kinds
    points = {r.name: r for r in tables["points"].collect()}
    assert points["St. 2"].bishop == "Bishop B" and points["St. 2"].patriarchate == "P" and points["St. 2"].seat_list[0].diocese == "Metropolis" and points["Lone"].region == "North America"
    assert {r.name: r.rows for r in tables["manifest"].collect()}["records"] == 8
    assert tables["groups"].filter("diocese = 'Metropolis'").first().n == 7
    assert tables["cells"].count() == tables["polygons"].filter("tier = 2").count() > 0


def test_failed_snapshots_leave_the_one_before(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        output.read_snapshot(spark, path)
    output.snapshot(spark, {"a": spark.range(3), "b": spark.range(1)}, path, "1")
    before = output.read_snapshot(spark, path)
    broken = spark.range(4).select(F.raise_error(F.lit("third table")).alias("id"))
    with pytest.raises(Exception, match="third table"):
        output.snapshot(spark, {"a": spark.range(9), "b": spark.range(9), "c": broken}, path, "2")
    assert {k: v.count() for k, v in output.read_snapshot(spark, path).items()} == {"a": 3, "b": 1}
    assert output.snapshot(spark, {"a": spark.range(5)}, path, "3").first().rows == 5
    assert {k: v.count() for k, v in output.read_snapshot(spark, path).items()} == {"a": 5}
    assert before["a"].count() == 3  # whoever reads the old one still can
    assert len(output.snapshots(spark, path)) == 2
    assert len(output.prune_snapshots(spark, path, 1)) == 2 and len(output.snapshots(spark, path)) == 1


def test_stages_that_are_kept_are_read_again(spark, tmp_path):
    ran, fails = [], [True]

    def a(t):
        ran.append("a")
        return t | {"x": t["in"].withColumn("a", F.col("id") + 1)}

    def b(t):
        ran.append("b")
        if fails[0]:
            raise ValueError("no")
        return t | {"y": t["x"].withColumn("b", F.col("a") * 2)}

    def p(factor=1):
        return Pipeline({"a": a, "b": b}, parameters={"b": factor})

    rows = spark.range(3)
    store = Store(spark, str(tmp_path / "kept"), table_fingerprint(rows))
    with pytest.raises(RuntimeError, match="stage b failed"):
        p().run({"in": rows}, ["a", "b"], store=store)
    fails[0] = False
    second = p()
    out = second.run({"in": rows}, ["a", "b"], store=store)
    assert ran == ["a", "b", "b"] and [x[1] for x in second.log] == ["kept", "done"]
    assert sorted(r.b for r in out["y"].collect()) == [2, 4, 6] and set(out) == {"in", "x", "y"}
    p().run({"in": rows}, ["a", "b"], store=store)
    assert ran == ["a", "b", "b"]
    p(2).run({"in": rows}, ["a", "b"], store=store)  # another parameter: its stage only
    assert ran == ["a", "b", "b", "b"]
    other = spark.range(4)
    p().run({"in": other}, ["a", "b"], store=Store(spark, store.folder, table_fingerprint(other)))
    assert ran == ["a", "b", "b", "b", "a", "b"]
    one = Pipeline({"a": lambda d: d.withColumn("a", F.lit(1))}, name="one")
    assert [one.run(rows, ["a"], store=store).columns for _ in range(2)] == [["id", "a"]] * 2 and [x[1] for x in one.log] == ["done", "kept"]


def test_fingerprints(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", [1.5]), (2, None, None), (1, "a", [1.5])], "id long, `a.b` string, v array<double>")
    same = table_fingerprint(rows.orderBy(F.desc("id")).repartition(3))
    assert table_fingerprint(rows) == same != table_fingerprint(rows.distinct())
    assert table_fingerprint(rows.limit(0)) != table_fingerprint(rows.limit(0).drop("v"))
    (tmp_path / "d").mkdir()
    first = folder_fingerprint(spark, str(tmp_path))
    (tmp_path / "d" / "x").write_text("1")
    assert first != folder_fingerprint(spark, str(tmp_path)) == folder_fingerprint(spark, f"{tmp_path}/")


def test_geometry_text(spark):
    ring = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0))])
    row = spark.range(1).select(output.geometry_of(output.feature(output.polygon(ring), id=F.col("id"))).alias("g"), output.geometry_of(F.to_json(output.point(F.lit(1.0), F.lit(2.0)))).alias("p")).first()
    assert row.g.type == "Polygon" and row.g.coordinates == "[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]]"
    assert row.p.type == "Point" and row.p.coordinates == "[1.0,2.0]"


def test_stream(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 00:00:00", 5, "a"), (1, 1, "2024-01-01 02:00:00", 6, "a"), (2, 1, "2024-01-01 01:00:00", 7, "b")]
    df = spark.createDataFrame(rows, "user_id long, place_id long, ts string, event_id long, event_type string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = visits.latest(stream).writeStream.outputMode("update").format("memory").queryName("latest_visits").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.user_id, r.event_id) for r in spark.table("latest_visits").collect()) == [(1, 6), (2, 7)]
    hours = visits.hourly(stream).writeStream.outputMode("complete").format("memory").queryName("hourly").start()
    hours.processAllAvailable()
    hours.stop()
    assert spark.table("hourly").count() == 3


def test_costly_cleaning_is_dealt_out(spark):
    one = spark.range(20).select(F.concat(F.lit("Fr. "), "id").alias("clergy")).coalesce(1)
    assert cleaning.clean_record(one).select("clergy").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = one.select(clergy(F.col("clergy")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert listed.count("regexp_extract_all") == 1  # persons are found once, and noise goes without a split by its pattern

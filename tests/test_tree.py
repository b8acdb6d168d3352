from __future__ import annotations

from pyspark.sql import functions as F

from atlasweave.sources import html, tree

FIELDS = {"heading": ("h2", "h3"), "phone": (".phone",), "cell": ("td",)}


def rows_of(spark, *sources):
    return spark.createDataFrame([(k, s) for k, s in enumerate(sources)], "page_id long, html string")


def test_tables_in_tables_and_open_cells(spark):
    inner = "<table><tr><th>In<tr><td>deep</table>"
    pages = rows_of(spark, f"<TABLE class='x'><thead><tr><th>Name</th><th>City</th></tr></thead><tbody><tr><td>A &amp; <b>B</b>'s</td><td>x {inner} y</td></tr><tr><td>C<tr><td>D<td>E<td>over</table>", None, "", "<table><tr><td>only</table>", "<tr><td>no table</td></tr>")
    got = sorted(tuple(r) for r in tree.tables(pages).collect())
    assert got == [
        (0, 0, 0, "City", "x In deep y"), (0, 0, 0, "Name", "A & B's"), (0, 0, 1, "City", ""), (0, 0, 1, "Name", "C"), (0, 0, 2, "City", "E"), (0, 0, 2, "Name", "D"), (0, 1, 0, "In", "deep"),
    ]
    assert tree.tables(pages.limit(0)).count() == 0


def test_blocks_end_with_their_own_tag(spark):
    nested = "<div class='big card' data-lat='4.5'><div><div>x</div><h3>One</h3></div><p><span class=phone>555</span><a href='https://x.example/?a=1&amp;b=2'>go</a></div><div class=card><h2>Two</h2></div>"
    pages = rows_of(spark, nested, "<li class='card'>a<div class='card'><h2>In</h2><i class='phone'>1</i></div><h2>Out</h2></li>", "<b class='card'>no</b><p class='cards'>no</p>", "<div class='card'>c</div><div class='parish'>p</div>")
    got = {(r.page_id, r.pos): (r.kind, r.text, r.href, r.fields) for r in tree.blocks(pages, ("parish", "card"), FIELDS).collect()}
    assert got == {
        (0, 0): ("card", "x One 555go", "https://x.example/?a=1&b=2", {"heading": "One", "phone": "555", "@lat": "4.5"}),
        (0, 1): ("card", "Two", "", {"heading": "Two"}),
        (1, 0): ("card", "a In 1 Out", "", {"heading": "In", "phone": "1"}),
        (1, 1): ("card", "In 1", "", {"heading": "In", "phone": "1"}),
        (3, 0): ("parish", "p", "", {}),
    }
    (place,) = html.blocks(rows_of(spark, "<div class='views-row'><div class='wrap'><i>x</i></div><h3>St. Mark</h3><span class='city-state'><b>Town</b>, OH 44101</span></div>")).collect()
    assert (place.name, place.city, place.state, place.kind) == ("St. Mark", "Town", "OH", "views-row")


def test_elements_against_a_plain_count(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = tree.elements(pages, "li").groupBy("page_id").agg(F.count("*").alias("n")).collect()
    want = {r.page_id: r.html.count("<li>") for r in pages.collect() if r.html and "<li>" in r.html}
    assert {r.page_id: r.n for r in got} == want
    nested = [tuple(r)[1:4] for r in tree.elements(rows_of(spark, "<ul><li>a<ul><li>b<li>c</ul><li>d</ul>"), "li").collect()]
    assert nested == [(0, -1, "a b c"), (1, 0, "b"), (2, 0, "c"), (3, -1, "d")]


def test_odd_markup(spark):
    deep = "<div class=card>" * 2000 + "<h2>x</h2>"
    odd = ["<![if gte mso]><div class=card><h2>a</h2><![endif]></div>", "<div class=card><h2>b</h2><script>'</div>'</script></h9></div>", "<div class=card <h2>", "<", "<div class=card><h2>&#x41;&unknown;</h2>", deep]
    got = tree.blocks(rows_of(spark, *odd), ("card",), FIELDS).groupBy("page_id").agg(F.count("*").alias("n"), F.max(F.col("fields")["heading"]).alias("h"))
    assert {r.page_id: (r.n, r.h) for r in got.collect()} == {0: (1, "a"), 1: (1, "b"), 2: (1, None), 4: (1, "A&unknown;"), 5: (2000, "x")}

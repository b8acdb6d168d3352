from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from atlasweave.functions import clergy, text
from atlasweave.functions.geo import haversine
from atlasweave.sources import html

L = F.lit


def cases():
    return [
        (text.clean(L("a\tb")), "ab"),
        (text.clean(L("Tom &amp; Jerry&nbsp;&copy;")), "Tom & Jerry"),
        (text.clean(L(None)), ""),
        (text.clean(L("a\r\nb  c ")), "a b c"),
        (text.title_case(L("HOLY trinity OF the OCA")), "Holy Trinity of the OCA"),
        (text.place_name(L('"St. Nicholas (www)"')), "St. Nicholas"),
        (text.place_name(L("STS. PETER")), "Sts. PETER"),
        (text.state_code(L("n.y.")), "NY"),
        (text.state_code(L("new york")), "NY"),
        (text.state_code(L("Ontario")), "ON"),
        (text.state_code(L("departement de l'ouest")), "Departement De L'ouest"),
        (text.state_code(L("Puerto Rico")), "PR"),
        (text.state_code(L("newfoundland & labrador")), "NL"),
        (text.country_name(L(""), L("GU")), "USA"),
        (text.country_name(L(""), L("ON")), "Canada"),
        (text.country_name(L("u.s."), L("")), "USA"),
        (text.country_name(L("Romania"), L("")), "Romania"),
        (text.jurisdiction_name(L(""), L("oca"), {}), "Orthodox Church in America (OCA)"),
        (text.jurisdiction_name(L("x"), L("oca"), {"x": "Y"}), "Y"),
        (text.phone(L("312.555.0147")), "(312) 555-0147"),
        (text.phone(L("+1 312 555 0147")), "(312) 555-0147"),
        (text.phone(L("011 1 312 555 0147")), "(312) 555-0147"),
        (text.phone(L("+40 241 619000")), "+40241619000"),
        (text.phone(L("01140241619000")), "+01140241619000"),
        (text.phone(L("555-0147")), "555-0147"),
        (text.phone(L("n/a")), ""),
        (text.zip_code(L("60614-1234")), "60614-1234"),
        (text.zip_code(L("m5v2t6")), "M5V 2T6"),
        (text.zip_code(L("60614 1234")), "60614 1234"),
        (text.website(L("/parish/1"), L("goarch")), "https://www.goarch.org/parish/1"),
        (text.website(L("/x"), L("oca")), ""),
        (text.website(L("WWW.Foo.ORG/"), L("")), "https://www.foo.org"),
        (text.website(L("http://Foo.org:80/a/../../b/./../c/../../d?x=1 2#y"), L("")), "http://foo.org/d?x=1%202#y"),
        (text.website(L("https://Foo.org:443/a/b/%2E%2e/.."), L("")), "https://foo.org"),
        (text.website(L("foo.org\\a/b/.."), L("")), "https://foo.org/a/"),
        (text.website(L("foo.org:80/1/2/3/4/5/6/../../../../../x"), L("")), "https://foo.org:80/1/x"),
        (text.coordinate(L("41.881832199"), 90.0), 41.8818322),
        (text.coordinate(L("91"), 90.0), None),
        (text.coordinate(L("12.5abc"), 180.0), 12.5),
        (text.norm_name(L("St. John Russian Orthodox")), "stjohnrussian"),
        (text.norm_name(L("OCA")), ""),
        (text.dedup_key(L("St. X"), L(""), L("NY")), "stx||ny"),
        (text.coord_key(L(0.0), L(5.0)), ""),
        (text.coord_key(L(1.5), L(-5.25)), "1.5000|-5.2500"),
        (text.jurisdiction_name(L("ROEA"), L("")), "Romanian Orthodox Archdiocese in the Americas"),
        (text.trimmed(L("\u00a0 a b\t")), "a b"),
        (text.colour(L("Church of Greece")), [200, 170, 30, 100]),
        (text.colour(L("x")), [128, 128, 128, 100]),
        (html.coordinates(L("parishLocation = { lat: 42, lng: -71 }")), "42,-71"),
        (html.coordinates(L("new_latitude = '1'; new_longitude = '-2.5'")), "1,-2.5"),
        (text.importance(L("X Cathedral Monastery")), "cathedral"),
        (text.importance(L("Holy Skete")), "monastery"),
        (text.importance(L("Basilika")), "notable"),
        (text.importance(L("Parish")), None),
        (clergy.clergy(L("V. Rev. John Smith Fr. Paul Jones")), "V. Rev. John Smith; Fr. Paul Jones"),
        (clergy.clergy(L("Fr. Paul Jones, Priest in Charge")), "Fr. Paul Jones, Priest in Charge"),
        (clergy.clergy(L("Rev. A (312) 555-0147 a@b.org")), "Rev. A"),
        (clergy.clergy(L("Served by: Fr. Priest Paul Jones; Warden: X Y; acting Rector Deacon B (emeritus)Protodeacon C")), "Fr. Priest Paul Jones; acting Rector Deacon B (emeritus); Protodeacon C"),
        (clergy.clergy(L("Very Rev. A, acting Priest B, PriestGeorge, Bishop of X")), "Very Rev. A, acting Priest B; Priest George, Bishop of X"),
        (F.round(haversine(L(0.0), L(0.0), L(0.0), L(90.0)), 3), 10007.543),
    ]


def test_table(spark):
    table = cases()
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, (c, _) in enumerate(table)]).first()
    wrong = [(k, row[k], want) for k, (_, want) in enumerate(table) if row[k] != want]
    assert not wrong


@pytest.mark.parametrize(("city", "want"), [("Palm Coast, Florida", ("Palm Coast", "Florida", "")), ("Chicago, IL, USA", ("Chicago", "IL", "USA")), ("Nassau, New Providence, Bahamas", ("Nassau", "", "")), ("Town", ("Town", "", ""))])
def test_city(spark, city, want):
    assert tuple(spark.range(1).select(text.city_parts(L(city), L(""), L("")).alias("p")).first().p) == want


def test_clergy_has_no_stray_separators(spark):
    rng = random.Random(5)
    parts = ["Fr. ", "Rev. ", "John ", "Paul ", "acting ", "priest ", "Deacon ", "; ", ", ", "in charge "]
    raw = ["".join(rng.choices(parts, k=rng.randint(0, 8))) for _ in range(300)]
    for (out,) in spark.createDataFrame([(x,) for x in raw], "x string").select(clergy.clergy(F.col("x"))).collect():
        assert out == out.strip(";, ")
        assert all(p.strip() for p in out.split(";")) or not out


def test_phone_and_zip_are_idempotent(spark):
    raw = ["312.555.0147", "+40 241 619000", "555-0147", "", None, "(1)", "m5v2t6", "60614-1234", "x y"]
    df = spark.createDataFrame([(x,) for x in raw], "x string")
    for f in (text.phone, text.zip_code):
        assert df.filter(f(f(F.col("x"))) != f(F.col("x"))).count() == 0

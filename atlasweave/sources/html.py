"""Extraction from pages with column expressions: links, titles, embedded JSON, headings carried forward, first strategy that yields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import city_state, collapse, trimmed
from ..functions.values import BLOCK_CLASSES, COORDINATES, FOOTERS, NAVIGATION, NAVIGATION_LABELS, NAVIGATION_PARTS, NAVIGATION_TARGET
from . import tree

_LINK = r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'


def strip_tags(c: Column) -> Column:
    return collapse(F.regexp_replace(c, "<[^>]*>", " "))


def links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """A row per link with its place in the page, target and text."""
    both = F.arrays_zip(F.regexp_extract_all(html_col, F.lit(_LINK), 1).alias("href"), F.regexp_extract_all(html_col, F.lit(_LINK), 2).alias("label"))
    rows = pages.select("page_id", F.posexplode(both).alias("pos", "link"))
    return rows.select("page_id", "pos", F.col("link.href").alias("href"), strip_tags(F.col("link.label")).alias("label"))


def titles(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Title and first heading of each page, '' if missing."""
    get = lambda tag: strip_tags(F.regexp_extract(html_col, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))
    return pages.select("page_id", get("title").alias("title"), get("h1").alias("heading"))


def embedded_json(pages: DataFrame, schema: str, html_col: str = "html") -> DataFrame:
    """Elements of arrays that scripts assign to parishes, markers or locations; broken JSON gives no rows."""
    raw = F.regexp_extract(html_col, r"(?s)(?:parishes|markers|locations)\s*[:=]\s*(\[.*?\])\s*;", 1)
    return pages.select("page_id", F.posexplode(F.from_json(raw, schema)).alias("pos", "item")).select("page_id", "pos", "item.*")


def table_rows(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(page_id, table, row, field, value) of table cells, named by the header row of their table."""
    return tree.tables(pages, html_col)


def carry_forward(rows: DataFrame, part: str, pos: str, value: Column, out_col: str) -> DataFrame:
    """The last non-null value at or before each row."""
    order = Window.partitionBy(part).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(out_col, F.last(value, ignorenulls=True).over(order))


def first_strategy(rows: DataFrame, part: str, strategy: str, least: int) -> DataFrame:
    """Of each part, the rows of the first strategy with at least so many; if none has, of the one with most, the first of equals."""
    counts = rows.groupBy(part, strategy).count()
    rank = F.struct(F.when(F.col("count") >= least, 0).otherwise(1), F.when(F.col("count") >= least, 0).otherwise(-F.col("count")), F.col(strategy))
    chosen = counts.groupBy(part).agg(F.min_by(strategy, rank).alias(strategy))
    return rows.join(chosen, [part, strategy], "left_semi")


def coordinates(html: Column) -> Column:
    """'lat,lng' by the first pattern that matches of those that map scripts and links use; '' if none does."""
    found = [F.nullif(F.concat_ws(",", F.regexp_extract(html, p, 1), F.regexp_extract(html, p, 2)), F.lit(",")) for p in COORDINATES]
    return F.coalesce(*found, F.lit(""))


def is_place_name(name: Column) -> Column:
    """Whether a label can name a place: of 4 to 200 characters, no navigation, no footer, no header cell."""
    return F.length(name).between(4, 200) & ~name.rlike(NAVIGATION) & ~name.rlike(FOOTERS) & ~name.rlike("(?i)^parish$")


def in_countries(country: Column, countries: tuple[str, ...] = ("USA", "Canada")) -> Column:
    return country.isin(*countries)


def place_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """links() that lead to places: with a label, and not to lists, searches, regions or the page of all."""
    label, href = F.col("label"), F.col("href")
    navigation = (F.length(label) < 4) | (href == NAVIGATION_TARGET)
    for pattern in NAVIGATION_LABELS:
        navigation = navigation | label.rlike(pattern)
    for part in NAVIGATION_PARTS:
        navigation = navigation | href.contains(part)
    return links(pages, html_col).filter(~navigation)


#: Fields of a block by tags and classes; a name is the first of the first four that is there.
_FIELDS = {
    "heading": ("h2", "h3", "h4", "h5"), "title": (".title", ".name", ".parish-name"), "link": ("a",), "cell": ("td",),
    "place": (".location", ".city-state", ".address"), "phone": (".phone",), "address": (".address", ".street"),
}


def blocks(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Places in repeated blocks: rows of the first class of blocks that a page has, with their fields, '' where missing."""
    of = lambda name: F.coalesce(F.col("fields")[name], F.lit(""))
    name = F.coalesce(*[F.nullif(of(x), F.lit("")) for x in ("heading", "title", "link", "cell")], F.lit(""))
    made = tree.blocks(pages, BLOCK_CLASSES, _FIELDS, html_col).select(
        "page_id", "pos", "kind", name.alias("name"), city_state(of("place")).alias("place"), of("phone").alias("phone"), F.col("href").alias("website"),
        of("address").alias("address"), of("@lat").alias("lat"), of("@lng").alias("lng"),
    )
    return made.filter(is_place_name(F.col("name"))).select("page_id", "pos", "kind", "name", "place.city", "place.state", "phone", "website", "address", "lat", "lng")


def details(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, phone, address, clergy, lat, lng) that a place's own page tells, '' where it doesn't."""
    html, plain = F.col(html_col), strip_tags(F.col(html_col))
    phone = trimmed(F.regexp_extract(plain, r"(?:Office|Phone|Tel|Telephone):\s*([\d(][\d\s\-().+]{6,})", 1))
    under = F.regexp_extract(html, r"(?is)<h2[^>]*>\s*(?:mailing\s+)?address\s*</h2>.*?<p[^>]*>(.*?)</p>", 1)
    lines_ = F.filter(F.transform(F.split(under, r"(?i)<br\s*/?>"), strip_tags), lambda x: (x != "") & ~x.rlike("(?i)^(US|USA)$"))
    told = trimmed(F.regexp_replace(F.regexp_extract(plain, r"(?i)Mailing address:\s*(.*?)(?:Parish Contacts|$)", 1), r"(?i)\s*(US|USA)\s*$", ""))
    names = F.regexp_extract_all(html, F.lit(r'(?is)class="contact"[^>]*>.*?class="name"[^>]*>(.*?)</'), 1)
    at = F.split(coordinates(html), ",")
    part = lambda k: F.coalesce(F.try_element_at(at, F.lit(k)), F.lit(""))
    return pages.select(
        F.col(url_col).alias("url"), phone.alias("phone"), F.coalesce(F.nullif(F.array_join(lines_, ", "), F.lit("")), told).alias("address"),
        F.array_join(F.filter(F.transform(names, strip_tags), lambda x: x != ""), "; ").alias("clergy"), part(1).alias("lat"), part(2).alias("lng"),
    )


def with_details(records: DataFrame, pages: DataFrame, url_col: str = "detailUrl") -> DataFrame:
    """Records with what they lack filled from their own pages, joined by address; a page met twice counts once."""
    fields = ("phone", "address", "clergy", "lat", "lng")
    told = details(pages).groupBy("url").agg(*[F.max(c).alias(f"__{c}") for c in fields])
    out = records.join(told, records[url_col] == told["url"], "left")
    return out.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}"), F.lit("")) for c in fields}).select(records.columns)


def line_records(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """A record of each page's lines: the first is the name, others are phone, clergy, city with state and ZIP, or address."""
    all_lines = F.filter(F.transform(F.split(html_col, r"(?i)<br\s*/?>"), strip_tags), lambda x: x != "")
    rows = pages.select("page_id", all_lines.alias("l")).select("page_id", F.coalesce(F.try_element_at("l", F.lit(1)), F.lit("")).alias("name"), F.expr("slice(l, 2, greatest(size(l) - 1, 0))").alias("l"))
    phone_, clergy_, city_ = r"^\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}$", r"(?i)^clergy:\s*", r"^([A-Za-z\s.]+),\s*([A-Z]{2})\s*(\d{5}(?:-\d{4})?)?$"
    is_phone = lambda x: F.regexp_replace(x, r"\s", "").rlike(phone_)
    is_clergy = lambda x: ~is_phone(x) & x.rlike(clergy_)
    is_city = lambda x: ~is_phone(x) & ~x.rlike(clergy_) & x.rlike(city_)
    of = lambda test: F.filter("l", test)
    last = lambda test: F.coalesce(F.try_element_at(of(test), F.lit(-1)), F.lit(""))
    city = lambda k: trimmed(F.regexp_extract(last(is_city), city_, k))
    zip_ = F.coalesce(F.try_element_at(F.filter(F.transform(of(is_city), lambda x: F.regexp_extract(x, city_, 3)), lambda x: x != ""), F.lit(-1)), F.lit(""))
    clergy = F.array_join(F.transform(of(is_clergy), lambda x: F.regexp_replace(x, clergy_, "")), "; ")
    address = F.array_join(of(lambda x: ~is_phone(x) & ~x.rlike(clergy_) & ~x.rlike(city_)), ", ")
    return rows.select("page_id", "name", last(is_phone).alias("phone"), clergy.alias("clergy"), city(1).alias("city"), city(2).alias("state"), zip_.alias("zip"), address.alias("address"))


def lines(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Lines between breaks with their kind: phone, clergy, city (ending in a state code and ZIP), or address."""
    parts = F.transform(F.split(html_col, r"(?i)<br\s*/?>"), strip_tags)
    rows = pages.select("page_id", F.posexplode(F.filter(parts, lambda x: x != "")).alias("pos", "line"))
    kind = (
        F.when(F.col("line").rlike(r"\(?\d{3}\)?[\s.-]+\d{3}[\s.-]+\d{4}"), "phone")
        .when(F.col("line").rlike(r"(?i)^(very |v\. ?)?(rev\.?|fr\.?|father|archpriest|priest|deacon)\b"), "clergy")
        .when(F.col("line").rlike(r",\s*[A-Z]{2}\s+\d{5}"), "city")
        .otherwise("address")
    )
    return rows.withColumn("kind", kind)

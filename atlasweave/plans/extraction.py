"""Queries of extraction from pages of places and of cleaned records, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.clergy import clergy
from ..functions.values import EUROPEAN_JURISDICTIONS, JURISDICTION_ALIASES, OTHER_EUROPEAN, SOURCE_JURISDICTIONS
from ..operators import cleaning
from ..sources import files, html, tree
from ..stages import spread
from .carriers import table, view


def _sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    view(spark, sf_dir, "supplier", "customer")
    return spark.sql(query)


def place_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all pages that can lead to places."""
    return html.place_links(table(spark, sf_dir, "pages")).select("page_id", F.col("pos").cast("long").alias("pos"), "href", "label")


_BLOCKS = """SELECT s_suppkey AS page_id, CASE CAST(s_suppkey % 4 AS INT)
    WHEN 0 THEN '<div class="views-row big" data-lat="4' || (s_suppkey % 9) || '.5" data-lng="-80.25"><h3> ' || s_name || '</h3><span class="city-state">Town, OH 44101</span><i class="phone">555</i><a href="https://x.example/' || s_suppkey || '">x</a></div><div class="views-row"><h3>abc</h3></div><div class="card"><h3>Not this</h3></div>'
    WHEN 1 THEN '<li class="church-item"><a href="/p">' || s_name || '</a><b class="address">1 Main St</b></li><li class="church-item"><a>Contact us now</a></li>'
    WHEN 2 THEN '<table><tr class="card"><td>' || s_name || '</td><td class="location">Kiev, Podil, Ukraine</td></tr></table>'
    ELSE '<p class="views-rows">' || s_name || '</p>' END AS html FROM supplier"""


def block_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in blocks of the first class of blocks that a page has."""
    return html.blocks(_sql(spark, sf_dir, _BLOCKS)).withColumn("pos", F.col("pos").cast("long"))


def menu_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All list items of all pages with their place, the item around them and their text, by a scan of the elements."""
    return tree.elements(table(spark, sf_dir, "pages"), "li").select("page_id", "pos", "up", "text")


_DETAILS = """SELECT 'https://x.example/' || s_suppkey AS url, CASE CAST(s_suppkey % 3 AS INT)
    WHEN 0 THEN '<h2>Address</h2><p>' || s_suppkey || ' Main St<br>Town, OH<br/>USA</p><p>Phone: (312) 555-0147</p><script>new_latitude = ''41.5''; new_longitude = ''-87''</script>'
    WHEN 1 THEN 'Mailing address: Box ' || s_suppkey || ' US Parish Contacts <div class="contact"><b class="name">Fr. ' || s_name || '</b></div><script>parishLocation = { lat: 42, lng: -71.25 }</script>'
    ELSE '<p>nothing</p>' END AS html FROM supplier"""
_ASKING = "SELECT s_suppkey, 'https://x.example/' || s_suppkey AS detailUrl, CASE WHEN s_suppkey % 6 = 0 THEN 'own' ELSE '' END AS phone, CAST(NULL AS STRING) AS address, '' AS clergy, '' AS lat, '' AS lng FROM supplier"


def detail_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with what they lack filled from their own pages."""
    pages = _sql(spark, sf_dir, _DETAILS)
    return html.with_details(spark.sql(_ASKING), pages)


_LINES = """SELECT s_suppkey AS page_id, '<b>' || s_name || '</b><br>12 Main St<BR/>Suite ' || s_suppkey || '<br>New Town, NY 10001-0002<br>(312) 555-0147<br>Clergy: Fr. A<br/>clergy: Dn. B' AS html FROM supplier"""


def line_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.line_records(_sql(spark, sf_dir, _LINES))


_NOISE = "SELECT s_suppkey, CASE CAST(s_suppkey % 6 AS INT) WHEN 0 THEN s_name WHEN 1 THEN 'abc' WHEN 2 THEN 'Contact ' || s_name WHEN 3 THEN repeat(s_name, 30) WHEN 4 THEN 'Powered by X' ELSE 'Parish' END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'USA' ELSE 'Cuba' END AS country FROM supplier"


def place_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that can be places', in the countries that are kept."""
    rows = _sql(spark, sf_dir, _NOISE)
    return rows.filter(html.is_place_name(F.col("name")) & html.in_countries(F.col("country"))).select("s_suppkey", "name")


_CITY = "SELECT c_custkey, CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'Town ' || c_custkey || ', OH 44101' WHEN 1 THEN 'Town, NY' WHEN 2 THEN 'He went, she said, to New Town, MA, by bus' ELSE 'Alone' END AS s FROM customer"


def city_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _CITY).select("c_custkey", text.city_state(F.col("s")).alias("p")).select("c_custkey", "p.city", "p.state")


_ALIASES = tuple(JURISDICTION_ALIASES)
_JURISDICTION = f"""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN 'Rare ' || c_custkey ELSE upper(element_at(array({", ".join(f"'{a}'" for a in _ALIASES)}), CAST(c_custkey % {len(_ALIASES)} AS INT) + 1)) END AS raw,
    element_at(array({", ".join(f"'{s}'" for s in [*SOURCE_JURISDICTIONS, *EUROPEAN_JURISDICTIONS, "none"])}), CAST(c_custkey % {len(SOURCE_JURISDICTIONS) + len(EUROPEAN_JURISDICTIONS) + 1} AS INT) + 1) AS source FROM customer"""


def jurisdiction_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, sf_dir, _JURISDICTION)
    return rows.select("c_custkey", text.jurisdiction_name(F.col("raw"), F.col("source")).alias("jurisdiction"), text.european_jurisdiction(F.col("source")).alias("european"))


_URLS = "SELECT c_custkey, CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN 'HTTP://WWW.Foo.ORG:80' WHEN 1 THEN 'foo.org/a b/./c/../d?q=x y' WHEN 2 THEN 'https://sub.foo.org:443/' WHEN 3 THEN 'https://foo.org?x=1' WHEN 4 THEN 'https://notfoo.org:8080/p/' ELSE '' END AS u FROM customer"


def url_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as browsers write them, and whether they are of a site."""
    made = _sql(spark, sf_dir, _URLS).select("c_custkey", text.website(F.col("u"), F.lit("oca")).alias("url"))
    return made.withColumn("same", text.same_site(F.col("url"), "foo.org")).withColumn("link", text.resolved(F.concat(F.lit("p/"), "c_custkey"), "https://foo.org/"))


#: Raw lists of clergy with what is read off them.
CLERGY = (
    ("V. Rev. John Smith Fr. Paul Jones", "V. Rev. John Smith; Fr. Paul Jones"),
    ("Fr. Paul Jones, Priest in Charge", "Fr. Paul Jones, Priest in Charge"),
    ("Rev. A (312) 555-0147 a@b.org", "Rev. A"),
    ("PriestGeorge Smith", "Priest George Smith"),
    ("Fr. Mark Lee, acting Priest Rev. John", "Fr. Mark Lee, acting Priest Rev. John"),
    ("Served by: Archpriest Basil (emeritus)Protodeacon Nicholas; Warden: J. Doe", "Archpriest Basil (emeritus); Protodeacon Nicholas"),
    ("Rev. John Doe; Mailing Address: PO Box 1", "Rev. John Doe"),
    ("", ""),
    ("The Very Most Reverend Archbishop Elias and Deacon Paul", "The Very Most Reverend Archbishop Elias and; Deacon Paul"),
    ("Metropolitan of Boston Bishop Luke", "Metropolitan of Boston; Bishop Luke"),
    ("  ;Fr.  Tikhon,, ", "Fr. Tikhon"),
    ("Hieromonk Seraphim; Reader Job.; Nun Mary", "Hieromonk Seraphim; Reader Job; Nun Mary"),
    ("Currently services held at - the hall; Dn. Luke", "Dn. Luke"),
    ("John Smith", "John Smith"),
)


def clergy_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = F.array(*[F.lit(raw) for raw, _ in CLERGY])
    raw = F.element_at(cases, (F.col("c_custkey") % len(CLERGY)).cast("int") + 1)
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", clergy(raw).alias("clergy"))


_RECORDS = """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '"St.  ' || c_name || ' (www)"' END AS name, 'Parish ' || c_custkey AS parish, 'goa' AS jurisdiction, ' d&amp;e ' AS diocese, CAST(NULL AS STRING) AS deanery,
    CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'Palm Coast, Florida' WHEN 1 THEN 'Chicago, IL, USA' ELSE 'Ponce' END AS city, CASE WHEN c_custkey % 3 = 2 THEN 'puerto rico' ELSE '' END AS state, '' AS country, '60614-1234' AS zip,
    '312.555.0147' AS phone, '' AS website, '/x' AS detailUrl, '41.881832199' AS lat, '999' AS lng, ' 1  Main ' AS address, 'PriestGeorge Smith' AS clergy, 'goarch' AS source FROM customer"""


def record_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records, all fifteen fields."""
    return cleaning.clean_record(_sql(spark, sf_dir, _RECORDS)).select("c_custkey", *cleaning.FIELDS)


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, time and state of each source, and of all."""
    log = _sql(spark, sf_dir, "SELECT 's' || (s_suppkey % 7) AS source, s_suppkey AS rows, CAST(s_suppkey % 5 AS DOUBLE) AS seconds, s_suppkey % 3 <> 0 AS ok FROM supplier")
    return files.run_summary(log)


QUERIES = {f.__name__: f for f in (place_links, block_scan, menu_items, detail_enrichment, line_fields, place_filter, city_state, jurisdiction_norm, url_absolute, clergy_split, record_clean, run_summary)}

_CASE = lambda key, table, other: f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"
ORACLES = {
    "place_links": r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2) AS t FROM pages),
        e AS (SELECT page_id, h, t, unnest(range(len(h))) AS pos FROM l),
        r AS (SELECT page_id, pos, h[pos + 1] AS href, trim(regexp_replace(regexp_replace(t[pos + 1], '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS label FROM e)
        SELECT * FROM r WHERE length(label) >= 4 AND NOT regexp_matches(label, '(?i)^(parishes|search|diocese|state|select|list)|deanery') AND href <> '/parishes'
        AND NOT (contains(href, '/search') OR contains(href, '/diocese/') OR contains(href, '/state/') OR contains(href, '/deanery/'))""",
    "menu_items": r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS t FROM pages), e AS (SELECT page_id, t, unnest(range(len(t))) AS pos FROM l)
        SELECT page_id, pos, CAST(-1 AS BIGINT) AS up, trim(regexp_replace(regexp_replace(t[pos + 1], '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS text FROM e""",
    "block_scan": """SELECT s_suppkey AS page_id, CAST(0 AS BIGINT) AS pos, CASE s_suppkey % 4 WHEN 0 THEN 'views-row' WHEN 1 THEN 'church-item' ELSE 'card' END AS kind, s_name AS name,
        CASE s_suppkey % 4 WHEN 0 THEN 'Town' WHEN 1 THEN '1 Main St' ELSE 'Kiev' END AS city, CASE s_suppkey % 4 WHEN 0 THEN 'OH' WHEN 1 THEN '' ELSE 'Podil' END AS state,
        CASE s_suppkey % 4 WHEN 0 THEN '555' ELSE '' END AS phone, CASE s_suppkey % 4 WHEN 0 THEN 'https://x.example/' || s_suppkey ELSE '' END AS website, CASE s_suppkey % 4 WHEN 1 THEN '1 Main St' ELSE '' END AS address,
        CASE s_suppkey % 4 WHEN 0 THEN '4' || (s_suppkey % 9) || '.5' ELSE '' END AS lat, CASE s_suppkey % 4 WHEN 0 THEN '-80.25' ELSE '' END AS lng FROM supplier WHERE s_suppkey % 4 <> 3""",
    "detail_enrichment": """SELECT s_suppkey, 'https://x.example/' || s_suppkey AS detailUrl, CASE WHEN s_suppkey % 6 = 0 THEN 'own' WHEN s_suppkey % 3 = 0 THEN '(312) 555-0147' ELSE '' END AS phone,
        CASE s_suppkey % 3 WHEN 0 THEN s_suppkey || ' Main St, Town, OH' WHEN 1 THEN 'Box ' || s_suppkey ELSE '' END AS address, CASE s_suppkey % 3 WHEN 1 THEN 'Fr. ' || s_name ELSE '' END AS clergy,
        CASE s_suppkey % 3 WHEN 0 THEN '41.5' WHEN 1 THEN '42' ELSE '' END AS lat, CASE s_suppkey % 3 WHEN 0 THEN '-87' WHEN 1 THEN '-71.25' ELSE '' END AS lng FROM supplier""",
    "line_fields": "SELECT s_suppkey AS page_id, s_name AS name, '(312) 555-0147' AS phone, 'Fr. A; Dn. B' AS clergy, 'New Town' AS city, 'NY' AS state, '10001-0002' AS zip, '12 Main St, Suite ' || s_suppkey AS address FROM supplier",
    "place_filter": f"""SELECT s_suppkey, name FROM ({_NOISE}) WHERE length(name) BETWEEN 4 AND 200 AND NOT regexp_matches(name, '(?i)^(home|about|contact|news|events|calendar|links|history)')
        AND NOT regexp_matches(name, '(?i)powered by|orthodox web solutions') AND lower(name) <> 'parish' AND country IN ('USA', 'Canada')""",
    "city_state": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Town ' || c_custkey WHEN 1 THEN 'Town' WHEN 2 THEN 'New Town' ELSE 'Alone' END AS city,
        CASE c_custkey % 4 WHEN 0 THEN 'OH' WHEN 1 THEN 'NY' WHEN 2 THEN 'MA' ELSE '' END AS state FROM customer""",
    "jurisdiction_norm": f"""WITH r AS ({_JURISDICTION.replace("element_at(array(", "list_extract(list_value(")})
        SELECT c_custkey, CASE WHEN raw = '' THEN {_CASE("source", SOURCE_JURISDICTIONS, "''")} ELSE {_CASE("lower(raw)", JURISDICTION_ALIASES, "raw")} END AS jurisdiction, {_CASE("source", EUROPEAN_JURISDICTIONS, f"'{OTHER_EUROPEAN}'")} AS european FROM r""",
    "url_absolute": """WITH u AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'http://www.foo.org' WHEN 1 THEN 'https://foo.org/a%20b/d?q=x%20y' WHEN 2 THEN 'https://sub.foo.org' WHEN 3 THEN 'https://foo.org/?x=1'
        WHEN 4 THEN 'https://notfoo.org:8080/p/' ELSE '' END AS url FROM customer) SELECT *, c_custkey % 6 < 4 AS same, 'https://foo.org/p/' || c_custkey AS link FROM u""",
    "clergy_split": f"""WITH v(k, s) AS (VALUES {", ".join(f"({k}, '{want}')" for k, (_, want) in enumerate(CLERGY))}) SELECT c_custkey, s AS clergy FROM customer JOIN v ON c_custkey % {len(CLERGY)} = k""",
    "record_clean": """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'St. ' || c_name ELSE 'Parish ' || c_custkey END AS name, 'Greek Orthodox Archdiocese of America' AS jurisdiction, 'd&e' AS diocese, '' AS deanery,
        CASE c_custkey % 3 WHEN 0 THEN 'Palm Coast' WHEN 1 THEN 'Chicago' ELSE 'Ponce' END AS city, CASE c_custkey % 3 WHEN 0 THEN 'FL' WHEN 1 THEN 'IL' ELSE 'PR' END AS state, '60614-1234' AS zip, 'USA' AS country, '(312) 555-0147' AS phone,
        'https://www.goarch.org/x' AS website, '41.8818322' AS lat, '' AS lng, '1 Main' AS address, 'Priest George Smith' AS clergy, 'goarch' AS source FROM customer""",
    "run_summary": """SELECT 's' || (s_suppkey % 7) AS source, CAST(sum(s_suppkey) AS BIGINT) AS rows, sum(CAST(s_suppkey % 5 AS DOUBLE)) AS seconds, count(*) FILTER (s_suppkey % 3 <> 0) AS succeeded, count(*) FILTER (s_suppkey % 3 = 0) AS failed FROM supplier GROUP BY 1
        UNION ALL SELECT NULL, CAST(sum(s_suppkey) AS BIGINT), sum(CAST(s_suppkey % 5 AS DOUBLE)), count(*) FILTER (s_suppkey % 3 <> 0), count(*) FILTER (s_suppkey % 3 = 0) FROM supplier""",
}

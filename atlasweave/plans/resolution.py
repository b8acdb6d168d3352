"""Queries of entity resolution and of the cleaning functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.values import CA_PROVINCES, COUNTRIES, SMALL_WORDS, SOURCE_PRIORITY, US_STATES
from ..operators import er
from .carriers import REC, rec, table

_PRIORITY = "CASE source " + " ".join(f"WHEN '{s}' THEN {p}" for s, p in SOURCE_PRIORITY.items()) + " ELSE 0 END"
_NORM = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"
_NAME = lambda c: f"regexp_replace({_NORM(c)}, '(orthodox|russian|rocor|oca|www)$', '')"
_KEY = f"CASE WHEN {_NAME('name')} = '' THEN '' WHEN {_NORM('city')} <> '' THEN {_NAME('name')} || '|' || {_NORM('city')} ELSE {_NAME('name')} || '||' || {_NORM('state')} END"
_COORD = "CASE WHEN coalesce(TRY_CAST(lat AS DOUBLE), 0) = 0 OR coalesce(TRY_CAST(lng AS DOUBLE), 0) = 0 THEN '' ELSE printf('%.4f', TRY_CAST(lat AS DOUBLE)) || '|' || printf('%.4f', TRY_CAST(lng AS DOUBLE)) END"


_SPACE = r"[\s\x{00A0}]"
_TRIM = lambda c: f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _merged(rows: str, key: str) -> str:
    """A group's fields, each from the source trusted most, then the longest without white space at its ends, then the first; and its sources."""
    fields = ", ".join(f"coalesce(arg_max({_TRIM(c)}, (p, length({_TRIM(c)}), -ord)) FILTER (WHERE {_TRIM(c)} <> ''), '') AS {c}" for c in er.FIELDS)
    parts = "list_filter(list_transform(flatten(list_transform(list(coalesce(source, '') ORDER BY ord), lambda s: string_split(s, ','))), lambda s: trim(s)), lambda s: s <> '')"
    return f"""SELECT {key}, {fields}, min(ord) AS ord, count(*) AS merged_rows, {parts} AS x FROM (SELECT *, {_PRIORITY} AS p FROM {rows}) GROUP BY {key}"""


_JOIN = "array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), ', ')"
_PASS1 = f"""rec AS ({REC}), keyed AS (SELECT *, {_KEY} AS dedup_key FROM rec),
    m1 AS ({_merged("(SELECT * FROM keyed WHERE dedup_key <> '')", "dedup_key")}),
    p1 AS (SELECT * EXCLUDE (x), {_JOIN} AS source FROM m1)"""
_PASS2 = f"""{_PASS1}, placed AS (SELECT * EXCLUDE (merged_rows), {_COORD} AS coord_key FROM p1),
    m2 AS ({_merged("(SELECT * FROM placed WHERE coord_key <> '')", "coord_key")}),
    p2 AS (SELECT coord_key, {", ".join(er.FIELDS)}, {_JOIN} AS source, ord, merged_rows FROM m2
           UNION ALL SELECT coord_key, {", ".join(er.FIELDS)}, source, ord, 1 FROM placed WHERE coord_key = '')"""


def er_pass1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return er.by_name(rec(spark, sf_dir)).drop("merged_rows")


def er_coord(spark: SparkSession, sf_dir: str) -> DataFrame:
    return er.by_place(rec(spark, sf_dir)).select("coord_key", *er.FIELDS, "source", "ord")


def er_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return er.resolve(rec(spark, sf_dir)).select("coord_key", *er.FIELDS, "source", "ord")


def er_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return er.stats(rec(spark, sf_dir))


def er_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return er.first_wins(rec(spark, sf_dir), [F.lower("name"), F.lower("city")]).select("ord", "name", "city", "source")


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean(F.col("text"))).alias("cleaned"))


_DUCK_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.title_case(F.concat_ws(" of the ", F.upper("p_name"), F.col("p_type"), F.lit("OCA"))).alias("title"))


def norm_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec(spark, sf_dir).select("ord", text.dedup_key(F.col("name"), F.col("city"), F.col("state")).alias("dedup_key"))


def name_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit('"St.  '), F.col("p_name"), F.lit(' (www)"'))
    return table(spark, sf_dir, "part").select("p_partkey", text.place_name(raw).alias("name"), text.norm_name(F.concat("p_name", F.lit(" Orthodox"))).alias("short"))


def phone_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN '312.555.' || (1000 + c_custkey % 9000) WHEN 1 THEN '+1 312 555 ' || (1000 + c_custkey % 9000) WHEN 2 THEN '011 1 312 555 ' || (1000 + c_custkey % 9000) WHEN 3 THEN '+40 241 ' || (100000 + c_custkey) WHEN 4 THEN '555-' || (1000 + c_custkey % 9000) ELSE 'n/a' END")
    return table(spark, sf_dir, "customer").select("c_custkey", text.phone(raw).alias("phone"))


def zip_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN '' || (10000 + c_custkey) WHEN 1 THEN (10000 + c_custkey) || '-' || (1000 + c_custkey % 9000) WHEN 2 THEN 'm' || (c_custkey % 10) || 'v' || ' 2t' || (c_custkey % 7) ELSE (10000 + c_custkey) || ' 1234' END")
    return table(spark, sf_dir, "customer").select("c_custkey", text.zip_code(raw).alias("zip"))


_STATE_RAW = "CASE CAST(s_suppkey % 9 AS INT) WHEN 0 THEN 'n.y.' WHEN 1 THEN 'new york' WHEN 2 THEN 'Ontario' WHEN 3 THEN 'tx' WHEN 4 THEN 'Puerto Rico' WHEN 5 THEN 'Newfoundland & Labrador' WHEN 6 THEN 'GU' WHEN 7 THEN '' ELSE 'province of ' || lower(s_name) END"
_COUNTRY_RAW = "CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'u.s.' WHEN 2 THEN 'Romania' ELSE 'united states of america' END"


_COUNTRY_STATE = "CASE CAST(s_suppkey % 5 AS INT) WHEN 0 THEN 'ON' WHEN 1 THEN 'ny' WHEN 2 THEN 'PR' WHEN 3 THEN 'VI' ELSE 'zz' END"


def state_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.state_code(F.expr(_STATE_RAW)).alias("state"))


def country_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.country_name(F.expr(_COUNTRY_RAW), F.expr(_COUNTRY_STATE)).alias("country"))


def url_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE CAST(page_id % 3 AS INT) WHEN 0 THEN regexp_replace(url, '^https?', 'HTTPS') WHEN 1 THEN '/p/' || page_id ELSE regexp_replace(url, '^https?://', '') END")
    source = F.expr("CASE CAST(page_id % 2 AS INT) WHEN 0 THEN 'goarch' ELSE 'oca' END")
    return table(spark, sf_dir, "pages").select("page_id", text.website(raw, source).alias("website"))


_CITY_RAW = "CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'Palm Coast, Florida' WHEN 1 THEN 'Chicago, IL, USA' WHEN 2 THEN 'Nassau, New Providence, Bahamas' WHEN 3 THEN 'Town ' || c_custkey ELSE 'Place ' || c_custkey || ', canada' END"


def city_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = text.city_parts(F.expr(_CITY_RAW), F.lit(""), F.lit(""))
    return table(spark, sf_dir, "customer").select("c_custkey", parts.alias("p")).select("c_custkey", "p.city", "p.state", "p.country")


_NUMBER_RAW = "CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN c_acctbal || 'abc' WHEN 1 THEN '41.881832199' WHEN 2 THEN 'x1' ELSE ' ' || (c_custkey % 200) || '.5' END"


def parse_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.coordinate(F.expr(_NUMBER_RAW), 90.0).alias("lat"), text.coordinate(F.expr(_NUMBER_RAW), 180.0).alias("lng"))


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'Holy Cathedral ' WHEN 1 THEN 'Monasteries of ' WHEN 2 THEN 'St. X Seminary ' WHEN 3 THEN 'Basilika ' WHEN 4 THEN 'Precathedrals ' ELSE '' END || p_name")
    return table(spark, sf_dir, "part").select("p_partkey", text.importance(name).alias("importance"))


def colour_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    colour = text.jittered(F.array(F.lit(10), F.lit(128), F.lit(250), F.lit(180)), F.concat(F.lit("p-"), F.col("p_partkey")))
    return table(spark, sf_dir, "part").select("p_partkey", *[colour[k].cast("long").alias(c) for k, c in enumerate(("r", "g", "b", "a"))])


QUERIES = {f.__name__: f for f in (er_merge, er_pass1, er_coord, er_stats, er_first_wins, clean_text, title_case, norm_key, name_norm, phone_norm, zip_norm, state_norm, country_norm, url_norm, city_split, parse_float, importance, colour_jitter)}

_F = ", ".join(er.FIELDS)
_SMALL = ", ".join(f"'{w}'" for w in SMALL_WORDS)
_TITLE = lambda c: f"""array_to_string(list_transform(string_split_regex({c}, '\\s+'), lambda w, i: CASE WHEN i > 1 AND lower(w) IN ({_SMALL}) THEN lower(w)
    WHEN regexp_full_match(w, '[A-Z]{{2,3}}') THEN w ELSE upper(lower(w)[1]) || lower(w)[2:] END), ' ')"""  # noqa: E731

_VALUES = lambda table: ", ".join(f"('{k}', '{v}')" for k, v in table.items())
_IN = lambda table: ", ".join(sorted({f"'{v}'" for v in table.values()}))
_NAMED = f"{_VALUES(US_STATES)}, {_VALUES(CA_PROVINCES)}"
_CODES = ", ".join(f"({c})" for c in f"{_IN(US_STATES)}, {_IN(CA_PROVINCES)}".split(", "))
ORACLES = {
    "er_pass1": f"WITH {_PASS1} SELECT dedup_key, {_F}, source, ord FROM p1",
    "er_coord": "WITH " + _PASS2.replace(_PASS1, f"p1 AS (SELECT *, 1 AS merged_rows FROM ({REC}))") + f" SELECT coord_key, {_F}, source, ord FROM p2",
    "er_merge": f"WITH {_PASS2} SELECT coord_key, {_F}, source, ord FROM p2",
    "er_stats": f"""WITH {_PASS2} SELECT (SELECT count(*) FROM rec) AS total, (SELECT count(*) FROM p2) AS unique_rows,
        CAST((SELECT coalesce(sum(merged_rows - 1), 0) FROM p1) + (SELECT coalesce(sum(merged_rows - 1), 0) FROM p2) AS BIGINT) AS merged""",
    "er_first_wins": f"SELECT ord, name, city, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), lower(city) ORDER BY ord) AS n FROM ({REC})) WHERE n = 1",
    "clean_text": rf"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(coalesce(text, ''),
        '[\x00-\x09\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\r?\n', ' ', 'g'), '&amp;', '&'), '&AMP;', '&'), '&nbsp;', ' '), '&NBSP;', ' '), '&#?\w+;', '', 'g'),
        '{_DUCK_SPACE}+', ' ', 'g'))) AS cleaned FROM documents""",
    "title_case": "SELECT p_partkey, " + _TITLE("upper(p_name) || ' of the ' || p_type || ' of the OCA'") + " AS title FROM part",
    "norm_key": f"SELECT ord, {_KEY} AS dedup_key FROM ({REC})",
    "name_norm": f"SELECT p_partkey, 'St. ' || p_name AS name, {_NORM('p_name')} AS short FROM part",
    "phone_norm": """SELECT c_custkey, CASE CAST(c_custkey % 6 AS INT) WHEN 3 THEN '+40241' || (100000 + c_custkey) WHEN 4 THEN '555-' || (1000 + c_custkey % 9000)
        WHEN 5 THEN '' ELSE '(312) 555-' || (1000 + c_custkey % 9000) END AS phone FROM customer""",
    "zip_norm": """SELECT c_custkey, CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN '' || (10000 + c_custkey) WHEN 1 THEN (10000 + c_custkey) || '-' || (1000 + c_custkey % 9000)
        WHEN 2 THEN 'M' || (c_custkey % 10) || 'V 2T' || (c_custkey % 7) ELSE (10000 + c_custkey) || ' 1234' END AS zip FROM customer""",
    "state_norm": f"""WITH r AS (SELECT s_suppkey, {_STATE_RAW} AS s FROM supplier), code(c) AS (VALUES {_CODES}), named(n, c) AS (VALUES {_NAMED})
        SELECT s_suppkey, coalesce(a.c, b.c, named.c, {_TITLE("s")}) AS state FROM r LEFT JOIN code a ON a.c = upper(s) LEFT JOIN code b ON b.c = regexp_replace(upper(s), '[^A-Z]', '', 'g') LEFT JOIN named ON n = lower(s)""",
    "country_norm": f"""WITH r AS (SELECT s_suppkey, {_COUNTRY_RAW} AS s, upper({_COUNTRY_STATE}) AS st FROM supplier), named(n, c) AS (VALUES {_VALUES(COUNTRIES)})
        SELECT s_suppkey, coalesce(c, CASE WHEN s <> '' THEN s WHEN st IN ({_IN(US_STATES)}) THEN 'USA' WHEN st IN ({_IN(CA_PROVINCES)}) THEN 'Canada' ELSE '' END) AS country FROM r LEFT JOIN named ON n = lower(s)""",
    "url_norm": r"""WITH w AS (SELECT page_id, CASE CAST(page_id % 3 AS INT) WHEN 0 THEN regexp_replace(url, '^https?', 'https') WHEN 1 THEN
        CASE CAST(page_id % 2 AS INT) WHEN 0 THEN 'https://www.goarch.org/p/' || page_id ELSE '' END ELSE regexp_replace(url, '^https?://', 'https://') END AS u FROM pages)
        SELECT page_id, lower(regexp_extract(u, '^([a-zA-Z]+://[^/?#]*)(.*)$', 1)) || CASE regexp_extract(u, '^([a-zA-Z]+://[^/?#]*)(.*)$', 2) WHEN '/' THEN ''
        ELSE regexp_extract(u, '^([a-zA-Z]+://[^/?#]*)(.*)$', 2) END AS website FROM w""",
    "city_split": """SELECT c_custkey, CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'Palm Coast' WHEN 1 THEN 'Chicago' WHEN 2 THEN 'Nassau' WHEN 3 THEN 'Town ' || c_custkey ELSE 'Place ' || c_custkey END AS city,
        CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'Florida' WHEN 1 THEN 'IL' ELSE '' END AS state,
        CASE CAST(c_custkey % 5 AS INT) WHEN 1 THEN 'USA' WHEN 4 THEN 'canada' ELSE '' END AS country FROM customer""",
    "parse_float": f"""WITH n AS (SELECT c_custkey, TRY_CAST(nullif(regexp_extract({_NUMBER_RAW}, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1), '') AS DOUBLE) AS x FROM customer)
        SELECT c_custkey, CASE WHEN x BETWEEN -90 AND 90 THEN round(x, 7) END AS lat, CASE WHEN x BETWEEN -180 AND 180 THEN round(x, 7) END AS lng FROM n""",
    "importance": """SELECT p_partkey, CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'cathedral' WHEN 1 THEN 'monastery' WHEN 2 THEN 'seminary' WHEN 3 THEN 'notable' END AS importance FROM part""",
    "colour_jitter": """WITH j AS (SELECT p_partkey, CAST(list_sum(list_transform(string_split('p-' || p_partkey, ''), lambda x: ascii(x))) AS BIGINT) % 60 - 30 AS m FROM part)
        SELECT p_partkey, greatest(0, least(255, 10 + m)) AS r, greatest(0, least(255, 128 + m)) AS g, greatest(0, least(255, 250 + m)) AS b, CAST(180 AS BIGINT) AS a FROM j""",
}

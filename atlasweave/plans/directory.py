"""Queries of lookups, aggregates, user state, extraction and output, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activity, enrich
from ..sources import html
from .carriers import ACT, REC, act, rec, table, view

_N = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


def parent_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    hierarchy = n.join(r, n.n_regionkey == r.r_regionkey).filter("n_nationkey % 5 <> 0").select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"), F.col("n_nationkey").alias("ord"))
    leaf = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == n.n_nationkey).select("s_suppkey", "n_name")
    return enrich.parent_of(leaf, hierarchy, "n_name")


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "nation", "region")
    return spark.sql("SELECT 'Diocese of ' || n_name AS entry, n_nationkey AS ord, r_name AS parent, array('S' || (n_nationkey % 7), 'S' || (n_nationkey % 3)) AS areas FROM nation JOIN region ON n_regionkey = r_regionkey")


_REGISTRY = "SELECT 'Diocese of ' || n_name AS entry, n_nationkey AS ord, r_name AS parent, ['S' || (n_nationkey % 7), 'S' || (n_nationkey % 3)] AS areas FROM nation JOIN region ON n_regionkey = r_regionkey"
_RAW_NAMES = "SELECT DISTINCT CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN n_name WHEN 1 THEN 'Diocese of ' || n_name ELSE 'Eparchy ' || s_suppkey END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def fuzzy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = _registry(spark, sf_dir)
    view(spark, sf_dir, "supplier")
    return enrich.fuzzy_names(spark.sql(_RAW_NAMES), registry)


def fuzzy_lookup_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without ASCII letters or digits match nothing."""
    registry = _registry(spark, sf_dir)
    view(spark, sf_dir, "supplier")
    return enrich.fuzzy_names(spark.sql(_RAW_NAMES + " UNION ALL SELECT 'Епархия'"), registry, fix=True)


_GROUPS = "SELECT s_suppkey, CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN n_name ELSE 'Own ' || s_suppkey END AS grp, CASE WHEN s_suppkey % 8 = 0 THEN '' ELSE r_name END AS parent FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def canonical_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = _registry(spark, sf_dir).filter("parent <> 'ASIA' OR ord = (SELECT min(n_nationkey) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')")
    view(spark, sf_dir, "supplier")
    return enrich.canonical_group(spark.sql(_GROUPS), registry, "grp", "parent")


_BACKFILL = "SELECT s_suppkey, r_name AS parent, 'S' || (s_suppkey % 8) AS area, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'Given' END AS grp FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def state_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = _registry(spark, sf_dir)
    view(spark, sf_dir, "supplier")
    return enrich.backfill(spark.sql(_BACKFILL), registry, "parent", "area", "grp")


def seat_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "nation", "supplier")
    seats = spark.sql("SELECT 'City' || (n_nationkey % 10) || ', R' || n_regionkey AS seat, n_name AS diocese, CASE WHEN n_nationkey % 2 = 0 THEN 'see' ELSE 'vicar' END AS type, n_nationkey AS ord FROM nation")
    rows = spark.sql("SELECT s_suppkey, 'City' || (s_suppkey % 12) AS city, 'R' || (s_suppkey % 5) AS state FROM supplier")
    return enrich.with_seats(rows, seats).select("s_suppkey", F.size("seat_list").cast("long").alias("seats"), F.array_join("seat_list.diocese", ";").alias("dioceses"))


def stats_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rec(spark, sf_dir)
    one = lambda level, c: r.filter(F.col(c) != "").groupBy(F.lit(level).alias("level"), F.col(c).alias("key")).agg(F.count("*").alias("n"))
    return one("jurisdiction", "jurisdiction").unionByName(one("state", "state")).unionByName(one("diocese", "diocese")).orderBy("level", F.desc("n"), "key")


def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rec(spark, sf_dir)
    return r.groupBy("jurisdiction", "diocese").agg(F.count("*").alias("n"), F.countDistinct("state").alias("states"))


def coverage_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rec(spark, sf_dir)
    share = lambda c: F.round(F.count_if(F.col(c) != "") * 100.0 / F.count("*"), 1).alias(f"{c}_pct")
    return r.groupBy(F.coalesce(F.nullif("jurisdiction", F.lit("")), F.lit("Unknown")).alias("jurisdiction")).agg(F.count("*").alias("n"), *[share(c) for c in ("lat", "phone", "website", "diocese")])


def topn_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec(spark, sf_dir).filter("country = 'USA' AND state <> ''").groupBy("state").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "state").limit(10)


def missing_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records lack coordinates, and how many of those could be looked up by address."""
    lacks = (F.col("lat") == "") & (F.col("lng") == "")
    return rec(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(lacks).alias("missing"), F.count_if(lacks & ((F.col("address") != "") | (F.col("city") != ""))).alias("lookup"))


def hierarchy_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree region, nation, suppliers, nested and in order; flat columns beside it."""
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    counts = s.groupBy("s_nationkey").agg(F.count("*").alias("n"))
    rows = r.join(n, r.r_regionkey == n.n_regionkey, "left").join(counts, n.n_nationkey == counts.s_nationkey, "left")
    leaf = F.struct(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"), F.coalesce("n", F.lit(0)).alias("n"))
    tree = rows.groupBy("r_name").agg(F.array_sort(F.collect_list(leaf)).alias("children"), F.sum(F.coalesce("n", F.lit(0))).alias("total"))
    return tree.select("r_name", F.size("children").cast("long").alias("child_count"), "total", F.array_join("children.name", ",").alias("names"))



def visit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, p = act(spark, sf_dir), rec(spark, sf_dir)
    return a.join(p, a.place_id == p.ord).select("event_id", "user_id", "place_id", "name", "city").orderBy(F.desc("event_id"))


def journal_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, p = act(spark, sf_dir), rec(spark, sf_dir).filter("ord % 2 = 0")
    return a.join(p, a.place_id == p.ord, "left").select("event_id", "user_id", F.col("name").alias("place_name"))


def profile_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile with two places of its own."""
    users = act(spark, sf_dir).groupBy("user_id").agg(F.min("place_id").alias("first_place"), F.max("place_id").alias("last_place"))
    p = rec(spark, sf_dir).select("ord", "name")
    first, last = p.alias("bp"), p.alias("cp")
    out = users.join(first, F.col("first_place") == F.col("bp.ord"), "left").join(last, F.col("last_place") == F.col("cp.ord"), "left")
    return out.select("user_id", F.col("bp.name").alias("first_name"), F.col("cp.name").alias("last_name"))


def goals_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's goals in order: open ones first, then the newest."""
    a = act(spark, sf_dir).withColumn("done", F.col("place_id") % 2)
    return a.orderBy("user_id", "done", F.desc("ts"), "event_id").select("event_id", "user_id", "done")


def goals_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All goals of every user, numbered: open ones first, then the newest."""
    a = act(spark, sf_dir).withColumn("done", F.col("place_id") % 2)
    return activity.numbered(a, ["user_id"], F.asc("done"), F.desc("ts"), F.asc("event_id")).select("event_id", "user_id", "done", "position")


def visit_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.latest(act(spark, sf_dir), ["user_id", "place_id"], "ts", "event_id").select("user_id", "place_id", "event_id")


def saved_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.earliest(act(spark, sf_dir), ["user_id", "place_id"], "ts", "event_id").select("user_id", "place_id", "event_id")


def owner_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = act(spark, sf_dir)
    return activity.delete(a, a.filter("event_type = 'click'"), ["user_id", "place_id"]).select("event_id", "user_id")


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = act(spark, sf_dir)
    users = a.select("user_id").distinct().filter("user_id % 3 <> 0")
    places = rec(spark, sf_dir).filter("ord % 2 = 0").select(F.col("ord").alias("place_id"))
    return activity.set_null(activity.cascade(a, users, "user_id"), places, "place_id").select("event_id", "user_id", "place_id")


def default_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = act(spark, sf_dir)
    kept = a.filter("user_id % 2 = 0").groupBy("user_id").agg(F.max("place_id").alias("theme")).withColumn("theme", F.when(F.col("user_id") % 4 != 0, F.col("theme")))
    return activity.with_defaults(a, kept, "user_id", {"theme": -1})


def owner_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals changed by their owners: empty types get the default, completed ones the time; of two changes the later holds."""
    a = act(spark, sf_dir).select("event_id", "user_id", "event_type", F.lit(False).alias("is_completed"), F.lit(None).cast("timestamp").alias("completed_at"), "ts")
    asked = a.filter("event_id % 4 = 0").select("event_id", "user_id", F.when(F.col("event_id") % 8 == 0, "").otherwise(F.concat("event_type", F.lit("!"))).alias("event_type"), (F.col("event_id") % 3 == 0).alias("done"), "ts", F.lit(2).alias("n"))
    asked = asked.unionByName(asked.withColumns({"event_type": F.lit("first"), "n": F.lit(1)}))
    done, at = activity.completion("done", F.col("ts"))
    changes = asked.select("event_id", "user_id", activity.or_default("event_type", "other"), done, at, "n")
    return activity.update(a, changes, ["event_id", "user_id"], ["event_type", "is_completed", "completed_at"], F.col("n")).drop("ts")


def plain_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = act(spark, sf_dir).select("event_id", "user_id", "event_type")
    return activity.append(a, a.filter("event_id < 10").select((F.col("event_id") + 1_000_000).alias("event_id"), "user_id"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.links(table(spark, sf_dir, "pages"))


def title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.titles(table(spark, sf_dir, "pages"))


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last user turn at or before each turn."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return html.carry_forward(c, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")), "last_user_turn")


def first_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each nation, the suppliers found by the first strategy with five rows or more."""
    s = table(spark, sf_dir, "supplier").withColumn("strategy", F.col("s_suppkey") % 3)
    return html.first_strategy(s, "s_nationkey", "strategy", 3).select("s_suppkey", "s_nationkey", "strategy")


def script_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "supplier")
    pages = spark.sql("""SELECT s_suppkey AS page_id, '<script>var markers = [{"name":"' || s_name || '","lat":' || (s_suppkey % 90) || '},{"name":"b","lat":1}' || CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE ']' END || ' ;</script>' AS html FROM supplier""")
    return html.embedded_json(pages, "array<struct<name:string,lat:double>>").select("page_id", F.col("pos").cast("long").alias("pos"), "name", "lat")


def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "supplier")
    pages = spark.sql("SELECT s_suppkey AS page_id, '<table><tr><th>Name</th><th>City</th></tr><tr><td> ' || s_name || ' </td><td><b>C' || s_nationkey || '</b></td></tr><tr><td>x</td></tr></table>' AS html FROM supplier")
    return html.table_rows(pages).select("page_id", F.col("row").cast("long").alias("row"), "field", "value")


QUERIES = {f.__name__: f for f in (
    parent_lookup, fuzzy_lookup, fuzzy_lookup_fixed, canonical_group, state_backfill, seat_enrich, stats_by_level, distinct_pairs, coverage_pct, topn_states, missing_coordinates, hierarchy_tree,
    visit_join, journal_left_join, profile_join, goals_sort, goals_order, visit_upsert, saved_insert_ignore, owner_delete, cascade_delete, default_row, owner_update, plain_insert,
    links, title_extract, carry_forward, first_strategy, script_json, table_scan,
)}

_MATCH = f"""SELECT name, arg_min(entry, (CASE WHEN entry = name THEN 0 ELSE 1 END, ord)) AS match FROM names LEFT JOIN registry
    ON contains({_N.format("entry")}, {_N.format("name")}) OR contains({_N.format("name")}, {_N.format("entry")}) OR entry = name GROUP BY name"""
_PICK = lambda order: f"SELECT user_id, place_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, place_id ORDER BY ts {order}, event_id {order}) AS n FROM ({ACT})) WHERE n = 1"
_TAG = lambda t: rf"trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<{t}[^>]*>(.*?)</{t}>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"

ORACLES = {
    "parent_lookup": """WITH h AS (SELECT n_name AS child, arg_min(r_name, n_nationkey) AS parent FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 0 GROUP BY n_name)
        SELECT s_suppkey, n_name, coalesce(parent, 'Unknown') AS parent FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN h ON child = n_name""",
    "fuzzy_lookup": f"WITH registry AS ({_REGISTRY}), names AS ({_RAW_NAMES}) {_MATCH}",
    "fuzzy_lookup_fixed": f"WITH registry AS ({_REGISTRY}), names AS ({_RAW_NAMES}) {_MATCH} UNION ALL SELECT 'Епархия', NULL",
    "canonical_group": f"""WITH all_reg AS ({_REGISTRY}), registry AS (SELECT * FROM all_reg WHERE parent <> 'ASIA' OR ord = (SELECT min(ord) FROM all_reg WHERE parent = 'ASIA')),
        g AS ({_GROUPS}), names AS (SELECT DISTINCT grp AS name FROM g WHERE trim(grp) <> ''), m AS ({_MATCH}),
        lone AS (SELECT parent AS p, min(entry) AS e FROM registry GROUP BY parent HAVING count(*) = 1)
        SELECT s_suppkey, grp, parent, coalesce(match, e, nullif(trim(grp), ''), nullif(trim(parent), ''), 'Unknown') AS canonical
        FROM g LEFT JOIN m ON name = grp LEFT JOIN lone ON p = parent""",
    "state_backfill": f"""WITH r AS (SELECT parent AS p, unnest(areas) AS a, entry, ord FROM ({_REGISTRY})), b AS (SELECT p, a, arg_max(entry, (length(entry), -ord)) AS e FROM r GROUP BY p, a)
        SELECT s_suppkey, parent, area, CASE WHEN trim(grp) = '' THEN coalesce(e, '') ELSE grp END AS grp FROM ({_BACKFILL}) LEFT JOIN b ON p = parent AND a = area""",
    "seat_enrich": """WITH s AS (SELECT 'City' || (n_nationkey % 10) || ', R' || n_regionkey AS seat, count(*) AS n, string_agg(n_name, ';' ORDER BY n_nationkey) AS d FROM nation GROUP BY 1)
        SELECT s_suppkey, coalesce(n, 0) AS seats, coalesce(d, '') AS dioceses FROM supplier LEFT JOIN s ON seat = 'City' || (s_suppkey % 12) || ', R' || (s_suppkey % 5)""",
    "stats_by_level": f"""WITH rec AS ({REC}) SELECT 'jurisdiction' AS level, jurisdiction AS key, count(*) AS n FROM rec WHERE jurisdiction <> '' GROUP BY 2
        UNION ALL SELECT 'state', state, count(*) FROM rec WHERE state <> '' GROUP BY 2 UNION ALL SELECT 'diocese', diocese, count(*) FROM rec WHERE diocese <> '' GROUP BY 2""",
    "distinct_pairs": f"SELECT jurisdiction, diocese, count(*) AS n, count(DISTINCT state) AS states FROM ({REC}) GROUP BY 1, 2",
    "coverage_pct": f"""SELECT coalesce(nullif(jurisdiction, ''), 'Unknown') AS jurisdiction, count(*) AS n, {", ".join(f"round(count(*) FILTER ({c} <> '') * 100.0 / count(*), 1) AS {c}_pct" for c in ("lat", "phone", "website", "diocese"))}
        FROM ({REC}) GROUP BY 1""",
    "topn_states": f"SELECT state, count(*) AS n FROM ({REC}) WHERE country = 'USA' AND state <> '' GROUP BY 1 ORDER BY n DESC, state LIMIT 10",
    "missing_coordinates": f"SELECT count(*) AS n, count(*) FILTER (lat = '' AND lng = '') AS missing, count(*) FILTER (lat = '' AND lng = '' AND (address <> '' OR city <> '')) AS lookup FROM ({REC})",
    "hierarchy_tree": """WITH c AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1)
        SELECT r_name, count(*) AS child_count, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total, string_agg(n_name, ',' ORDER BY n_nationkey) AS names
        FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN c ON s_nationkey = n_nationkey GROUP BY r_name""",
    "visit_join": f"SELECT event_id, user_id, place_id, name, city FROM ({ACT}) JOIN ({REC}) ON place_id = ord",
    "journal_left_join": f"SELECT event_id, user_id, name AS place_name FROM ({ACT}) LEFT JOIN (SELECT * FROM ({REC}) WHERE ord % 2 = 0) ON place_id = ord",
    "profile_join": f"""WITH u AS (SELECT user_id, min(place_id) AS a, max(place_id) AS b FROM ({ACT}) GROUP BY 1), p AS ({REC})
        SELECT user_id, x.name AS first_name, y.name AS last_name FROM u LEFT JOIN p x ON a = x.ord LEFT JOIN p y ON b = y.ord""",
    "goals_sort": f"SELECT event_id, user_id, place_id % 2 AS done FROM ({ACT})",
    "goals_order": f"""SELECT event_id, user_id, place_id % 2 AS done, row_number() OVER (PARTITION BY user_id ORDER BY place_id % 2 NULLS FIRST, ts DESC NULLS LAST, event_id NULLS FIRST) AS position
        FROM ({ACT})""",
    "visit_upsert": _PICK("DESC"),
    "saved_insert_ignore": _PICK("ASC"),
    "owner_delete": f"WITH a AS ({ACT}) SELECT event_id, user_id FROM a WHERE NOT EXISTS (SELECT 1 FROM a d WHERE d.event_type = 'click' AND d.user_id = a.user_id AND d.place_id = a.place_id)",
    "cascade_delete": f"SELECT event_id, user_id, CASE WHEN place_id % 2 = 0 AND place_id IN (SELECT p_partkey FROM part) THEN place_id END AS place_id FROM ({ACT}) WHERE user_id % 3 <> 0",
    "default_row": f"SELECT user_id, CASE WHEN user_id % 4 = 0 THEN NULL WHEN user_id % 2 = 0 THEN max(place_id) ELSE -1 END AS theme FROM ({ACT}) GROUP BY user_id",
    "owner_update": f"""SELECT event_id, user_id, CASE WHEN event_id % 8 = 0 THEN 'other' WHEN event_id % 4 = 0 THEN event_type || '!' ELSE event_type END AS event_type,
        event_id % 12 = 0 AS is_completed, CASE WHEN event_id % 12 = 0 THEN ts END AS completed_at FROM ({ACT})""",
    "plain_insert": f"SELECT event_id, user_id, event_type FROM ({ACT}) UNION ALL SELECT event_id + 1000000, user_id, NULL FROM ({ACT}) WHERE event_id < 10",
    "links": r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2) AS t FROM pages),
        e AS (SELECT page_id, h, t, unnest(range(len(h))) AS pos FROM l)
        SELECT page_id, CAST(pos AS INT) AS pos, h[pos + 1] AS href, trim(regexp_replace(regexp_replace(t[pos + 1], '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS label FROM e""",
    "title_extract": f"SELECT page_id, {_TAG('title')} AS title, {_TAG('h1')} AS heading FROM pages",
    "carry_forward": "SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user_turn FROM conversations",
    "first_strategy": """WITH s AS (SELECT *, s_suppkey % 3 AS strategy FROM supplier), c AS (SELECT s_nationkey, strategy, count(*) AS n FROM s GROUP BY 1, 2),
        b AS (SELECT s_nationkey, arg_min(strategy, (CASE WHEN n >= 3 THEN 0 ELSE 1 END, CASE WHEN n >= 3 THEN 0 ELSE -n END, strategy)) AS strategy FROM c GROUP BY 1)
        SELECT s_suppkey, s.s_nationkey, s.strategy FROM s JOIN b ON s.s_nationkey = b.s_nationkey AND s.strategy = b.strategy""",
    "script_json": """SELECT s_suppkey AS page_id, p AS pos, CASE p WHEN 0 THEN s_name ELSE 'b' END AS name, CASE p WHEN 0 THEN CAST(s_suppkey % 90 AS DOUBLE) ELSE 1 END AS lat
        FROM supplier, (VALUES (CAST(0 AS BIGINT)), (1)) v(p) WHERE s_suppkey % 5 <> 0""",
    "table_scan": """SELECT s_suppkey AS page_id, CAST(0 AS BIGINT) AS row, 'Name' AS field, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 0, 'City', 'C' || s_nationkey FROM supplier
        UNION ALL SELECT s_suppkey, 1, 'Name', 'x' FROM supplier UNION ALL SELECT s_suppkey, 1, 'City', '' FROM supplier""",
}

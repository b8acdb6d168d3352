"""Files of records, pages and reference tables: JSON arrays and maps, CSV, text, folders, and unions of sources with differing columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import FIELD_ALIASES, LOCAL_KEYS, SOURCE_FILES

FIELDS = ("name", "jurisdiction", "diocese", "deanery", "city", "state", "zip", "country", "phone", "website", "lat", "lng", "address", "clergy", "source")
_EXTRA = sorted({a for aliases in FIELD_ALIASES.values() for a in aliases} - set(FIELDS) | {"address2"})
#: Raw records: what any source may give, all strings.
RECORD = ", ".join(f"{c} string" for c in (*FIELDS, *_EXTRA))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def filled(*columns: str) -> Column:
    """The first of some columns that is not empty; '' if none."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(""))


def read_json(spark: SparkSession, path: str, source: str, ord_: int) -> DataFrame:
    """A JSON array file of raw records with their usual field names, source, and places among the sources and in the file.

    Broken records are left out.
    """
    rows = spark.read.schema(RECORD).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return named_fields(rows, source, ord_)


def named_fields(rows: DataFrame, source: str, ord_: int) -> DataFrame:
    """Raw records with each field taken from the first of its names that is filled; missing ones stay null."""
    have = {c.lower() for c in rows.columns}
    of = lambda c: [a for a in FIELD_ALIASES.get(c, (c,)) if a.lower() in have]
    field = {c: F.nullif(filled(*of(c)), F.lit("")) if of(c) else F.lit(None).cast("string") for c in FIELDS}
    if "address2" in have:
        field["address"] = F.nullif(F.concat_ws(", ", field["address"], F.nullif("address2", F.lit(""))), F.lit(""))
    field["source"] = F.coalesce(field["source"], F.lit(source))
    detail = F.col("detailUrl") if "detailurl" in have else F.lit(None).cast("string")
    row = F.monotonically_increasing_id().alias("row_ord")  # files are read whole, so it follows the file's order
    return rows.select(*[field[c].alias(c) for c in FIELDS], detail.alias("detailUrl"), F.lit(ord_).alias("source_ord"), row)


def local_key(source: str) -> Column | None:
    """What tells a source's rows apart, null if its rows are all kept."""
    parts = LOCAL_KEYS.get(source)
    if parts is None:
        return None
    low = {"detailUrl or name": filled("detailUrl", "name"), "name letters": F.regexp_replace(F.lower(filled("name")), "[^a-z0-9]", "")}
    return F.concat_ws("|", *[F.lower(low.get(p, filled(p) if p not in low else low[p])) for p in parts])


def first_of_source(rows: DataFrame, source: str) -> DataFrame:
    """A source's rows without those whose key an earlier one has."""
    key = local_key(source)
    if key is None:
        return rows
    order = Window.partitionBy(key).orderBy("source_ord", "row_ord")
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def read_sources(spark: SparkSession, folder: str, sources: tuple[str, ...] = SOURCE_FILES) -> DataFrame:
    """Raw records of all sources whose files are there, each source's repeated rows once; ord is a record's place in all."""
    found = [first_of_source(read_json(spark, f"{folder}/{s}.json", s, k), s) for k, s in enumerate(sources) if exists(spark, f"{folder}/{s}.json")]
    rows = union_all(found) if found else named_fields(spark.createDataFrame([], RECORD), "", 0)
    return rows.withColumn("ord", F.col("source_ord").cast("long") * (1 << 40) + F.col("row_ord"))


def inline(spark: SparkSession, rows: list[dict[str, str]], source: str, ord_: int = 0) -> DataFrame:
    """Constant rows as raw records."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    return named_fields(spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], RECORD), source, ord_)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of a folder of pages, a file each; url is the file's address."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def read_enveloped(spark: SparkSession, path: str, source: str, ord_: int = 0) -> DataFrame:
    """Raw records of JSON pages that are arrays or hold one as data, parishes or results."""
    text = spark.read.text(path, wholetext=True)
    array = f"array<struct<{', '.join(c.replace(' ', ': ') for c in RECORD.split(', '))}>>"
    inside = [F.from_json(F.get_json_object("value", f"$.{k}"), array) for k in ("data", "parishes", "results")]
    return named_fields(text.select(F.inline(F.coalesce(F.when(F.ltrim("value").startswith("["), F.from_json("value", array)), *inside))), source, ord_)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(source) names of the JSON files in a folder but for that of all records."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("source"))
    return files.filter("source <> 'all-parishes'").distinct()


def _entries(spark: SparkSession, path: str, kind: str, at: str | None = None) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    value = F.get_json_object("value", at) if at else F.col("value")
    return text.select(F.posexplode(F.from_json(value, f"map<string, {kind}>")).alias("ord", "key", "v"))


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """(parent, child, ord) of a JSON object of lists of children."""
    rows = _entries(spark, path, "array<string>")
    return rows.select(F.col("key").alias("parent"), F.posexplode("v").alias("at", "child"), "ord").select("parent", "child", (F.col("ord") * 10_000 + F.col("at")).alias("ord"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(entry, ord, parent, region, areas, bishop) of a JSON object of groups by name."""
    rows = _entries(spark, path, "struct<jurisdiction: string, region: string, states: array<string>, bishop: string>")
    return rows.select(F.col("key").alias("entry"), "ord", F.col("v.jurisdiction").alias("parent"), "v.region", F.col("v.states").alias("areas"), "v.bishop")


def read_seats(spark: SparkSession, path: str) -> DataFrame:
    """(diocese, seat, jurisdiction, type, notes, ord) of a JSON object with bishopLocations."""
    rows = _entries(spark, path, "struct<seat: string, jurisdiction: string, type: string, notes: string>", "$.bishopLocations")
    return rows.select(F.col("key").alias("diocese"), "v.seat", "v.jurisdiction", "v.type", "v.notes", "ord")


def capped(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in an order: a limit that a source's interface sets."""
    return rows.orderBy(order).limit(n)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all sources; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.select("*") for f in frames])


def merged_if_several(frames: dict[str, DataFrame]) -> DataFrame | None:
    """All sources' rows as one table; None for a single source, whose rows are no new table of all."""
    return union_all(list(frames.values())) if len(frames) > 1 else None


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object per line."""
    df.write.mode("overwrite").json(path)


def classify_error(status: str, code: str) -> Column:
    """rate_limit, server, client, timeout, network or unknown, from a status and an error code."""
    s, c = F.col(status), F.col(code)
    return (
        F.when(s == 429, "rate_limit").when(s >= 500, "server").when(s >= 400, "client")
        .when(c.isin("ECONNABORTED", "ETIMEDOUT"), "timeout").when(c.isin("ENOTFOUND", "ECONNREFUSED", "ECONNRESET", "EAI_AGAIN"), "network").otherwise("unknown")
    )


def run_summary(log: DataFrame) -> DataFrame:
    """Of a log (source, rows, seconds, ok): rows, seconds and state of each source, and of all under a null source."""
    total = F.sum("rows").alias("rows"), F.sum("seconds").alias("seconds"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed")
    return log.rollup("source").agg(*total)

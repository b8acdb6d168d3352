"""What the directory serves: map features, snapshots with a manifest, and tables brought to a schema."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..stages import delete, listed

_VERSION = re.compile(r"\d{8,}-[0-9a-f]{8}")
_MANIFEST = "_manifest"


def point(lng: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates"))


def polygon(ring: Column) -> Column:
    """A polygon of one ring, which is closed if it isn't."""
    closed = F.when(F.try_element_at(ring, F.lit(1)) == F.try_element_at(ring, F.lit(-1)), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    return F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))


def multi_polygon(rings: Column) -> Column:
    """Polygons of one ring each, as one geometry; each is closed if it isn't."""
    closed = F.transform(rings, lambda r: F.array(F.when(F.try_element_at(r, F.lit(1)) == F.try_element_at(r, F.lit(-1)), r).otherwise(F.concat(r, F.slice(r, 1, 1)))))
    return F.struct(F.lit("MultiPolygon").alias("type"), closed.alias("coordinates"))


def feature(geometry: Column, **properties: Column) -> Column:
    """A GeoJSON feature as text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*[c.alias(k) for k, c in properties.items()]).alias("properties"), geometry.alias("geometry")))


def geometry_of(text: Column) -> Column:
    """The geometry's type and coordinates as text, of a feature or of a bare geometry."""
    parsed = lambda path: F.get_json_object(text, path)
    return F.struct(F.coalesce(parsed("$.geometry.type"), parsed("$.type")).alias("type"), F.coalesce(parsed("$.geometry.coordinates"), parsed("$.coordinates")).alias("coordinates"))


def snapshot(spark: SparkSession, tables: dict[str, DataFrame], path: str, version: str) -> DataFrame:
    """Write the tables to a folder of their own under path, and last their manifest (version, name, rows), which is returned.

    A snapshot is current once its manifest is whole, so a failure on the way leaves the one before as it was, and readers
    of that one keep their files. Nothing is renamed, which object stores can't do in one step.
    """
    numbers = [int(name.split("-")[0]) for name, is_folder, *_ in listed(spark, path) if is_folder and _VERSION.fullmatch(name)]
    folder = f"{path}/{max(numbers, default=0) + 1:08d}-{uuid.uuid4().hex[:8]}"
    rows = []
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
        rows.append((version, name, spark.read.parquet(f"{folder}/{name}").count()))
    manifest = spark.createDataFrame(rows, "version string, name string, rows long").coalesce(1)
    manifest.write.json(f"{folder}/{_MANIFEST}")
    return manifest


def snapshots(spark: SparkSession, path: str) -> list[str]:
    """Folders of whole snapshots under path, the latest last."""
    folders = [f"{path}/{name}" for name, is_folder, *_ in listed(spark, path) if is_folder and _VERSION.fullmatch(name)]
    return [f for f in folders if any(name == "_SUCCESS" for name, *_ in listed(spark, f"{f}/{_MANIFEST}"))]


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the current snapshot by name; without one an error."""
    whole = snapshots(spark, path)
    if not whole:
        raise FileNotFoundError(f"no whole snapshot under {path}")
    names = spark.read.schema("version string, name string, rows long").json(f"{whole[-1]}/{_MANIFEST}").select("name")
    return {r.name: spark.read.parquet(f"{whole[-1]}/{r.name}") for r in names.collect()}  # a row for each table


def prune_snapshots(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete all but the latest whole snapshots, and what failed before the first of those; the folders deleted are returned."""
    whole = snapshots(spark, path)
    kept = whole[-max(keep, 1) :]
    folders = [f"{path}/{name}" for name, is_folder, *_ in listed(spark, path) if is_folder and _VERSION.fullmatch(name)]
    gone = [f for f in folders if kept and f < kept[0]]
    for folder in gone:
        delete(spark, folder)
    return gone


def with_columns_of(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with columns that the schema has and df lacks, as nulls of their types, in the schema's order."""
    have = {c.lower() for c in df.columns}
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def fill_coordinates(df: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Rows without both coordinates get those of their address from a gazetteer (place, lat, lng); others stay as they are.

    The address joins its non-blank parts, country USA if blank.
    """
    parts = [F.nullif(F.trim(c), F.lit("")) for c in ("address", "city", "state")]
    place = F.concat_ws(", ", *parts, F.coalesce(F.nullif(F.trim("country"), F.lit("")), F.lit("USA")))
    wanted = F.col("lat").isNull() & F.col("lng").isNull() & (F.coalesce(parts[0], parts[1]).isNotNull())
    named = gazetteer.groupBy("place").agg(F.min(F.struct("lat", "lng")).alias("at"))
    out = df.withColumn("__place", F.when(wanted, place)).join(named, F.col("__place") == F.col("place"), "left")
    return out.withColumns({"lat": F.coalesce("lat", "at.lat"), "lng": F.coalesce("lng", "at.lng")}).drop("__place", "place", "at")


def member_rows(rows: DataFrame, key: str) -> DataFrame:
    """(key, position, id, name) of all members of each key, numbered from 1 by id."""
    position = F.row_number().over(Window.partitionBy(key).orderBy("id", "name")).cast("long")
    return rows.select(key, position.alias("position"), "id", "name")

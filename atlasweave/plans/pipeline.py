"""The directory's build as ordered stages: choose some, list them, run them, and log how each went."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, enrich, er, output, polygons, served, spatial
from ..sources import files
from ..stages import discard, listed, staged

Tables = dict[str, DataFrame]
Stage = Callable[[Any], Any]
#: Where cells end: west, south, east, north.
WORLD = (-180.0, -85.0, 180.0, 85.0)


def table_fingerprint(df: DataFrame) -> str:
    """A digest of a table's columns and of its rows in any order, repeated ones counted: one pass, summed in the tasks first."""
    rows = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    sums = [F.sum(F.xxhash64(F.lit(seed), rows).cast("decimal(38,0)")) for seed in (1, 2)]
    return hashlib.sha256(repr((df.schema.simpleString(), tuple(df.agg(F.count(F.lit(1)), *sums).first()))).encode()).hexdigest()


def folder_fingerprint(spark: SparkSession, folder: str) -> str:
    """A digest of names, lengths and times of change of a folder's files; the files themselves are not read."""
    found, waiting = [], [folder.rstrip("/")]
    while waiting:
        at = waiting.pop()
        for name, is_folder, length, changed in listed(spark, at):
            if is_folder:
                waiting.append(f"{at}/{name}")
            else:
                found.append((f"{at}/{name}", length, changed))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


@dataclass
class Store:
    """Outputs of stages, kept under a digest of all that they depend on: the inputs, and the stages with their parameters
    up to them. The inputs' digest comes from table_fingerprint and folder_fingerprint.

    An output counts once it is whole. Tables that a stage hands on unchanged are not written again.
    """

    spark: SparkSession
    folder: str
    inputs: str

    def key(self, before: str, stage: str, parameters: Any) -> str:
        return hashlib.sha256(repr((before, stage, parameters)).encode()).hexdigest()[:32]

    def get(self, key: str) -> Tables | None:
        path = f"{self.folder}/{key}"
        return output.read_snapshot(self.spark, path) if output.snapshots(self.spark, path) else None

    def put(self, key: str, tables: Tables) -> Tables:
        output.snapshot(self.spark, tables, f"{self.folder}/{key}", key)
        for df in tables.values():
            if hasattr(df, "stage_path"):
                discard(df)
        return output.read_snapshot(self.spark, f"{self.folder}/{key}")


@dataclass
class Pipeline:
    """Named stages; serving is left out unless it is asked for.

    With a store, a stage whose output is kept is read and not run, unless it acts on something outside (always). Outputs
    are told apart by the pipeline's name, the inputs' digest, and the names and parameters of the stages up to theirs, in
    the order run; code is not looked at, so a stage that computes something else now needs another parameter.
    """

    stages: dict[str, Stage]
    asked_only: frozenset[str] = frozenset({"serve"})
    log: list[tuple[str, str, float, str]] = field(default_factory=list)
    always: frozenset[str] = frozenset({"snapshot", "serve"})
    parameters: dict[str, Any] = field(default_factory=dict)
    name: str = ""

    def choose(self, only: str | None = None, stages: list[str] | None = None, start: str | None = None, skip: list[str] | None = None) -> list[str]:
        """The stages to run, in order; an unknown name is an error."""
        names = list(self.stages)
        unknown = {x for x in (only, start, *(stages or ()), *(skip or ())) if x} - set(names)
        if unknown:
            raise ValueError(f"unknown stages: {', '.join(sorted(unknown))}")
        if only or stages:
            wanted = {only} if only else set(stages or ())
            return [n for n in names if n in wanted and n not in (skip or ())]
        names = names[names.index(start) if start else 0 :]
        return [n for n in names if n not in (skip or ()) and n not in self.asked_only]

    def run(self, df: Any, chosen: list[str], dry: bool = False, store: Store | None = None) -> Any:
        """Run the chosen stages on a table or on tables by name; the first failure ends the run, and the error tells where to resume."""
        key = store.key(store.inputs, "", self.name) if store else ""
        for name in chosen:
            began = time.monotonic()
            if dry:
                self.log.append((name, "listed", 0.0, ""))
                continue
            status = "done"
            try:
                if store is None or name in self.always:
                    df = self.stages[name](df)
                else:
                    key = store.key(key, name, self.parameters.get(name))
                    df, status = self._kept(df, name, key, store)
            except Exception as error:
                self.log.append((name, "failed", time.monotonic() - began, str(error)[:200]))
                raise RuntimeError(f"stage {name} failed; resume with start={name!r}") from error
            self.log.append((name, status, time.monotonic() - began, ""))
        return df

    def _kept(self, df: Any, name: str, key: str, store: Store) -> tuple[Any, str]:
        """The stage's output from the store, made and put there if it is missing."""
        several, found = isinstance(df, dict), store.get(key)
        status = "done" if found is None else "kept"
        if found is None:
            made = self.stages[name](df)
            changed = {k: v for k, v in made.items() if v is not df.get(k)} if several else {"table": made}
            found = store.put(key, changed)
        return (df | found if several else found["table"]), status

    def report(self, spark: SparkSession) -> DataFrame:
        """The log with durations as read by people."""
        rows = spark.createDataFrame(self.log, "stage string, status string, seconds double, error string")
        return rows.withColumn("took", duration(F.col("seconds")))


def duration(seconds: Column) -> Column:
    """ms below a second, s below a minute, minutes and seconds above."""
    minutes = F.concat_ws(" ", F.concat(F.floor(seconds / 60), F.lit("m")), F.concat(F.floor(seconds % 60), F.lit("s")))
    return F.when(seconds < 1, F.concat(F.round(seconds * 1000).cast("int"), F.lit("ms"))).when(seconds < 60, F.concat(F.round(seconds, 1), F.lit("s"))).otherwise(minutes)


@dataclass
class Lookups:
    """The reference tables of a build."""

    hierarchy: DataFrame  # parent, child, ord
    registry: DataFrame  # entry, ord, parent, region, areas, bishop
    seats: DataFrame  # seat, diocese, type, ord
    gazetteer: DataFrame  # place, lat, lng


def directory_pipeline() -> Pipeline:
    """Clean records, merge by name, merge by place: records in, resolved records out."""
    return Pipeline({"clean": cleaning.clean_record, "by_name": er.by_name, "by_place": er.by_place}, frozenset(), name="records")


def directory_build(spark: SparkSession, folder: str, lookups: Lookups, out: str, version: str = "1", box: tuple[float, float, float, float] = WORLD) -> Pipeline:
    """The whole build over tables by name, from raw files in folder to a snapshot under out: read and clean all sources, merge,
    enrich by reference tables, fill coordinates, make the table of records, compute clusters and shapes, write, serve."""

    def scrape(t: Tables) -> Tables:
        return t | {"records": staged(cleaning.clean_record(files.read_sources(spark, folder)), "scraped")}

    def dedup(t: Tables) -> Tables:
        return t | {"records": staged(er.resolve(t["records"]), "merged")}

    def enriched(t: Tables) -> Tables:
        rows = enrich.backfill(t["records"], lookups.registry, "jurisdiction", "state", "diocese")
        return t | {"records": enrich.with_seats(enrich.parent_of(rows, lookups.hierarchy, "jurisdiction", "patriarchate"), lookups.seats)}

    def geocode(t: Tables) -> Tables:
        number = {c: F.nullif(F.col(c).try_cast("double"), F.lit(0.0)) for c in ("lat", "lng")}
        return t | {"records": output.fill_coordinates(t["records"].withColumns(number), lookups.gazetteer)}

    def import_(t: Tables) -> Tables:
        return t | {"records": staged(t["records"].withColumnRenamed("ord", "id"), "records")}

    def compute(t: Tables) -> Tables:
        placed = t["records"].filter("lat IS NOT NULL AND lng IS NOT NULL")
        named = enrich.canonical_group(placed, lookups.registry, "diocese", "jurisdiction", "grp").select("id", "grp", "jurisdiction", "lat", "lng", "name")
        points = staged(spatial.redistribute(named), "points")
        labelled = staged(spatial.clusters(points), "clusters")
        groups = spatial.summary(points, labelled)
        of = points.groupBy("grp").agg(F.min_by("jurisdiction", "id").alias("jurisdiction"))
        sites = spatial.representatives(points, labelled)
        named_sites = sites.select(F.col("key").alias("id"), "grp", "lat", "lng")
        cells = polygons.voronoi(named_sites, box).join(named_sites.select("id", "grp"), "id").select("id", "grp", F.array("ring").alias("rings"), F.lit(2).alias("tier"))
        outlines = polygons.outlines(points).select(F.col("grp").alias("id"), "grp", "rings", F.lit(1).alias("tier"))
        shapes = cells.unionByName(outlines).join(of, "grp")
        kind = F.when(F.col("tier") == 1, "diocese").otherwise("parish")
        shapes = shapes.select(kind.alias("entity_type"), F.col("id").alias("entity_id"), F.col("grp").alias("diocese"), "jurisdiction", "tier", F.to_json(output.multi_polygon(F.col("rings"))).alias("geojson"))
        members = output.member_rows(points.join(labelled.select("id", "cluster"), "id").withColumn("key", F.coalesce(F.concat(F.lit("c-"), "cluster"), F.concat(F.lit("p-"), "id"))), "key")
        return t | {"clusters": groups, "polygons": staged(shapes, "polygons"), "members": members}

    def snapshot(t: Tables) -> Tables:
        return t | {"manifest": output.snapshot(spark, {k: t[k] for k in ("records", "clusters", "polygons", "members")}, out, version)}

    def serve(t: Tables) -> Tables:
        current = output.read_snapshot(spark, out)
        records, shapes = current["records"], current["polygons"]
        plain = records.drop("seat_list", "patriarchate", "region", "bishop")
        found = {"points": served.map_points(plain, lookups.registry, lookups.hierarchy, lookups.seats), "groups": served.map_groups(shapes, records, lookups.registry, lookups.hierarchy), "cells": served.map_cells(shapes)}
        return t | found

    return Pipeline({"scrape": scrape, "dedup": dedup, "enrich": enriched, "geocode": geocode, "import": import_, "compute": compute, "snapshot": snapshot, "serve": serve}, parameters={"scrape": folder, "compute": box}, name="directory")

"""WARC archives of pages: written, normalised to a gzip member for each record, and read back by offset.

1. `records` makes a WARC record of each row. Of rows with equal payloads the one with the least id is a response, others are
   revisits of it, which carry the headers of their answer and no payload.
2. `write_monolithic` writes them as Spark writes text: a file is one gzip stream with all its records, which nothing can be
   read from without inflating what stands before.
3. `normalise` inflates each such stream once, from its beginning to its end and with no more in memory than a record, writes
   every record as a gzip member of its own into a new archive, and beside the archives an index of offsets.
4. `read_records` reads records by that index: any task seeks to any of them, so a large archive is read by many.

A lost executor costs its tasks: text and index are committed by Spark, and an archive has a name of its own for each attempt,
so that what a failed attempt has left is named by no index (`sweep` deletes it). Monolithic files may come from any store
that Spark reads, archives go to one that pyarrow.fs reaches (local and mounted folders, HDFS, S3, GCS).

Odd input: a null payload is an empty one, a null url an empty one; control characters and blanks of an url are escaped.
Rows alike in id and payload are alike in role too: each row with the least id of its payload is a response. Null ids come
after all others; if a payload has only such rows, all are responses. An empty table gives no archive and an empty index.
Further columns don't pass.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_arrow, staged

SCHEME = "urn:row:"
DATE = "1970-01-01T00:00:00Z"
#: What ends a record.
END = "\r\n\r\n"
#: The profile of revisits, a fixed value of the standard.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: How hard members are compressed, and bytes of an archive that a task reads at once, and reads in all, about.
LEVEL, CHUNK, TASK_BYTES = 3, 4 << 20, 16 << 20

INDEX = "archive string, offset long, length long, record_id string, record_type string, target_uri string, payload_digest string"
READ = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, intact boolean"


def base32(hex_digits: Column) -> Column:
    """Base32 in upper case of hexadecimal digits, five of which make four characters; for digests of 160 bits."""
    letters = F.array(*[F.lit(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"])
    number = lambda k: F.conv(F.substring(hex_digits, k * 5 + 1, 5), 16, 10).cast("int")
    quad = lambda n: F.concat(*[F.element_at(letters, F.shiftright(n, 15 - 5 * j).bitwiseAND(31) + 1) for j in range(4)])
    return F.array_join(F.transform(F.array(*[number(k) for k in range(8)]), quad), "")


def with_roles(df: DataFrame, id_col: str, payload_col: str, least: int = 0, scratch: list[DataFrame] | None = None) -> DataFrame:
    """df with `refers_to`, the id of the row whose payload a row repeats, null for responses.

    Payloads of fewer bytes than least are never shared. Only payloads that occur more than once, by SHA-256, are joined, a
    row for each, so however many rows one has, they meet in a join that Spark broadcasts or splits.
    """
    key = F.unhex(F.sha2(F.coalesce(F.col(payload_col), F.lit("")), 256))
    shared = df.select(F.col(id_col).alias("id"), key.alias("key")).filter(F.octet_length(F.coalesce(F.col(payload_col), F.lit(""))) >= least)
    repeated = staged(shared.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first"), "repeated")
    if scratch is not None:
        scratch.append(repeated)
    rows = df.withColumn("__key", key).join(repeated.withColumnRenamed("key", "__key"), "__key", "left")
    return rows.withColumn("refers_to", F.when(~F.col(id_col).eqNullSafe(F.col("first")), F.col("first"))).drop("__key", "first")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, scratch: list[DataFrame] | None = None) -> DataFrame:
    """(record) a WARC record of each row, without what ends it."""
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = with_roles(rows, "id", "payload", least, scratch)
    rows = rows.withColumns({"size": F.octet_length("payload"), "digest": F.sha1("payload"), "repeats": F.col("refers_to").isNotNull()})
    named = lambda c: F.concat(F.lit(f"<{SCHEME}"), F.coalesce(F.concat(F.lit("id:"), F.url_encode(F.col(c).cast("string"))), F.lit("null")), F.lit(">"))
    target = F.regexp_replace(F.regexp_replace("url", r"[\x00-\x1f\x7f]", ""), " ", "%20")
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(END))
    revisit = F.when(F.col("repeats"), F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), named("refers_to"))).otherwise("")
    body = F.concat(block, F.when(F.col("repeats"), "").otherwise(F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(F.col("repeats"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), named("id"), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), target,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.col("digest")), revisit,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block) + F.when(F.col("repeats"), 0).otherwise(F.col("size")), F.lit(END),
    )
    return rows.select(F.concat(head, body).alias("record"))


def write_monolithic(record_rows: DataFrame, folder: str) -> None:
    """Write records as files of one gzip stream each, by Spark's own writer."""
    record_rows.write.option("compression", "gzip").option("lineSep", END).option("zlib.compress.level", "BEST_SPEED").text(folder)


class Stream:
    """Cuts what is fed to it into whole WARC records; it holds no more than what has come of the next one."""

    def __init__(self, name: str) -> None:
        self.name, self.parts, self.held, self.need = name, [], 0, 1

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.parts.append(data)
        self.held += len(data)
        if self.held < self.need:
            return
        buf, at = b"".join(self.parts), 0
        while True:
            while buf[at : at + 1] in (b"\r", b"\n"):
                at += 1
            end = buf.find(b"\r\n\r\n", at)
            if end < 0:
                self.need = len(buf) - at + 1
                break
            length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", buf[at:end])
            if not buf.startswith(b"WARC/", at) or length is None:
                raise ValueError(f"{self.name}: no WARC record where one should begin")
            stop = end + 4 + int(length[1])
            if stop > len(buf):
                self.need = stop - at
                break
            yield buf[at:stop]
            at = stop
        self.parts, self.held = [buf[at:]], len(buf) - at

    def close(self) -> None:
        if b"".join(self.parts).strip(b"\r\n"):
            raise ValueError(f"{self.name}: it ends within a record")


def headers(record: bytes) -> dict[str, str]:
    """The named fields of a record, names in lower case."""
    lines = record[: record.find(b"\r\n\r\n")].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _plain(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite all archives in the folder source, gzip streams of any kind, to target, and return the index: a row for each record.

    A source file is read by one task, as no part of such a stream can be inflated by itself.
    """
    files, path = _plain(target)
    files.create_dir(f"{path}/archives", recursive=True)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_files, out_path = _plain(target)
        name, stream, out, at, archive, rows = None, None, None, 0, "", []

        def keep(found: Iterator[bytes]) -> None:
            nonlocal at
            for record in found:
                member = gzip.compress(record + END.encode(), LEVEL, mtime=0)
                out.write(member)
                h = headers(record)
                rows.append((archive, at, len(member), h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-payload-digest")))
                at += len(member)

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            made = pa.record_batch([pa.array(c, pa.int64() if k in (1, 2) else pa.string()) for k, c in enumerate(columns)], names=[x.split()[0] for x in INDEX.split(", ")])
            rows.clear()
            return made

        for b in batches:
            here, lines, start = b.column(0).to_pylist(), b.column(1).to_pylist(), 0
            while start < len(here):
                stop = len(here) if here[-1] == here[start] else next(k for k in range(start, len(here)) if here[k] != here[start])
                if here[start] != name:
                    if stream is not None:
                        stream.close()
                        out.close()
                    name = here[start]
                    archive, at = f"{re.sub(r'[^A-Za-z0-9-].*', '', name.rsplit('/', 1)[-1])[:40]}-{uuid.uuid4().hex}.warc.gz", 0
                    stream, out = Stream(name), out_files.open_output_stream(f"{out_path}/archives/{archive}", compression=None)
                keep(stream.feed(b"\n".join(lines[start:stop]) + b"\n"))
                start = stop
            if len(rows) >= 4096:
                yield batch()
        if stream is not None:
            stream.close()
            out.close()
        yield batch()

    lines = spark.read.option("lineSep", "\n").text(source).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    map_arrow(lines, rewrite, INDEX).write.parquet(f"{target}/index")
    return spark.read.schema(INDEX).parquet(f"{target}/index")


def sweep(index: DataFrame, target: str) -> int:
    """Delete archives that no row of the index names, left by attempts that failed; returns how many."""
    files, path = _plain(target)
    there = [f.base_name for f in files.get_file_info(fs.FileSelector(f"{path}/archives"))]
    names = index.sparkSession.createDataFrame([(x,) for x in there], "archive string")
    stray = [r.archive for r in names.join(index.select("archive").distinct(), "archive", "left_anti").collect()]  # names of files
    for name in stray:
        files.delete_file(f"{path}/archives/{name}")
    return len(stray)


def read_records(index: DataFrame, target: str, payload: bool = False) -> DataFrame:
    """The records that an index names, with their payloads if asked for (null for revisits, whose digest and size are those of what they revisit).

    Rows of the index are dealt by place, so that a task reads on through a part of an archive. intact tells whether a
    response's payload has the digest and size that its headers give.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    dealt = index.select("archive", "offset", "length").repartitionByRange(int(total // TASK_BYTES) + 1, "archive", "offset").sortWithinPartitions("archive", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _plain(target)
        name, source = None, None
        for b in batches:
            archives, offsets, lengths = (b.column(k).to_pylist() for k in range(3))
            start = 0
            while start < len(archives):
                stop, size = start, 0  # records that lie behind one another, about a chunk of them
                while stop < len(archives) and archives[stop] == archives[start] and offsets[stop] == offsets[start] + size and (size < CHUNK or stop == start):
                    size += lengths[stop]
                    stop += 1
                if archives[start] != name:
                    if source is not None:
                        source.close()
                    name, source = archives[start], files.open_input_file(f"{path}/archives/{archives[start]}")
                source.seek(offsets[start])
                data = memoryview(source.read(size))
                rows = [parsed(zlib.decompress(data[offsets[k] - offsets[start] :][: lengths[k]], 31), payload) for k in range(start, stop)]
                names = [x.split()[0] for x in READ.split(", ")] + ["payload"] * payload
                kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.bool_()] + [pa.binary()] * payload
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                start = stop
        if source is not None:
            source.close()

    return map_arrow(dealt, read, READ + ", payload binary" * payload)


def parsed(record: bytes, payload: bool = False) -> tuple:
    """What READ names of a record."""
    h = headers(record)
    block = record[record.find(b"\r\n\r\n") + 4 : -4]
    edge = block.find(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:[ \t]*(\d+)", block[:edge])
    said, body = h.get("warc-payload-digest", "").removeprefix("sha1:"), block[edge + 4 :]
    if h.get("warc-type") == "revisit":
        return (h.get("warc-record-id"), "revisit", h.get("warc-target-uri"), h.get("warc-refers-to"), int(size[1]) if size else None, said, True, *[None] * payload)
    own = base64.b32encode(hashlib.sha1(body).digest()).decode()
    return (h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-refers-to"), len(body), own, own == said and (size is None or int(size[1]) == len(body)), *[body] * payload)


def id_of(name: Column, kind: str = "string") -> Column:
    """The id of a row by its record's name."""
    return F.url_decode(F.nullif(F.regexp_extract(name, rf"^<{SCHEME}id:(.*)>$", 1), F.lit(""))).cast(kind)


def archived(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Write pages to folder as normalised archives with their index, by way of monolithic ones, and return the index."""
    spark = pages.sparkSession
    scratch: list[DataFrame] = []
    write_monolithic(records(pages, id_col, url_col, payload_col, least, scratch), f"{folder}/monolithic")
    index = normalise(spark, f"{folder}/monolithic", folder)
    index.stage_path = f"{folder}/monolithic"
    discard(index, *scratch)
    index.stage_path = folder
    return index


def page_roles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) as the archives of pages tell, which are deleted when they have been read."""
    kind = pages.schema[id_col].dataType.simpleString()
    index = archived(pages, folder, id_col, url_col, payload_col, least)
    found = read_records(index, folder)
    broken = F.when(~F.col("intact"), F.raise_error(F.lit("a payload differs from its digest")))
    rows = staged(found.select(id_of(F.col("record_id"), kind).alias("id"), "payload_bytes", "payload_digest", F.coalesce(broken, "record_type").alias("record_type"), id_of(F.col("refers_to"), kind).alias("refers_to")), "warc")
    discard(index)
    return rows

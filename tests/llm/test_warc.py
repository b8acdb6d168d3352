from __future__ import annotations

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from atlasweave.llm import warc


def expected(rows, least=0):
    """By a plain loop over all rows."""
    first = {}
    for k, _, html in rows:
        if k is not None:
            first[html or ""] = min(k, first.get(html or "", k))
    out = []
    for k, _, html in rows:
        body = (html or "").encode()
        at = first.get(html or "") if len(body) >= least else None
        again = at is not None and at != k
        out.append((k, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", at if again else None))
    return sorted(out, key=str)


def some_rows():
    rng = random.Random(1)
    texts = ["", None, "<p>a</p>", "WARC/1.0\r\n\r\nContent-Length: 5\r\n\r\n", "\r\n\r\n\n\n", "x" * 300_000 + "\n" * 999, "ż▁\u0085퟿𝄞", *("".join(rng.choices("ab\n\r ", k=rng.randint(0, 9))) for _ in range(60))]
    rows = [(k, f"https://x.example/{k} \r\n?q=ü", rng.choice(texts)) for k in range(150)]
    return [*rows, (7, None, rows[7][2]), (None, "u", "<p>a</p>"), (None, "u", "only here"), (None, "u", "only here"), (-3, "", "<p>a</p>")]


@pytest.mark.parametrize("least", [0, 4])
def test_roles_and_round_trip(spark, tmp_path, least):
    rows = some_rows()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("record", F.lit(1)).withColumn("size", F.lit("x"))
    found = warc.page_roles(df, str(tmp_path / "w"), least=least).collect()
    assert sorted((tuple(r) for r in found), key=str) == expected(rows, least)


def test_archives_have_a_member_for_each_record_and_an_index(spark, tmp_path):
    rows = some_rows()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    warc.write_monolithic(warc.records(df), str(tmp_path / "mono"))
    for file in (tmp_path / "mono").glob("*.gz"):  # one member, in which all records stand
        assert file.read_bytes().count(b"\x1f\x8b\x08\x00") <= 1 + gzip.decompress(file.read_bytes()).count(b"WARC/1.0")
    index = warc.normalise(spark, str(tmp_path / "mono"), str(tmp_path / "out"))
    stored = {f.name: f.read_bytes() for f in (tmp_path / "out" / "archives").iterdir()}
    entries = index.collect()
    assert len(entries) == len(rows) and sum(r.length for r in entries) == sum(map(len, stored.values()))
    for r in entries:
        record = gzip.decompress(stored[r.archive][r.offset : r.offset + r.length])
        assert record.startswith(b"WARC/1.0\r\n") and record.endswith(b"\r\n\r\n") and r.record_id.encode() in record
    payloads = {r.record_id: bytes(r.payload) for r in warc.read_records(index, str(tmp_path / "out"), payload=True).filter("record_type = 'response'").collect()}
    firsts = {k: h for k, _, h in rows if k is not None}
    assert all(payloads[f"<urn:row:id:{k}>"] == (firsts[k] or "").encode() for k in firsts if f"<urn:row:id:{k}>" in payloads) and len(payloads) > 40
    again = warc.normalise(spark, str(tmp_path / "out" / "archives"), str(tmp_path / "twice"))  # archives of members are normalised as well
    assert again.count() == len(rows)
    (tmp_path / "out" / "archives" / "stray.warc.gz").write_bytes(b"")
    assert warc.sweep(index, str(tmp_path / "out")) == 1 and warc.sweep(index, str(tmp_path / "out")) == 0


def test_damaged_streams_are_errors(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "in" / "a.gz").write_bytes(gzip.compress(good + good[:-8]))
    with pytest.raises(Exception, match="ends within a record"):
        warc.normalise(spark, str(tmp_path / "in"), str(tmp_path / "o1"))
    (tmp_path / "in" / "a.gz").write_bytes(gzip.compress(good + b"junk\r\n\r\n"))
    with pytest.raises(Exception, match="no WARC record"):
        warc.normalise(spark, str(tmp_path / "in"), str(tmp_path / "o2"))


def test_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id string, url string, html string")
    assert warc.page_roles(df, str(tmp_path / "w")).collect() == []


def test_stream_is_cut_wherever_it_is_fed():
    record = b"WARC/1.1\r\nContent-Length: 7\r\n\r\nab\r\n\r\nc"
    data = (record + b"\r\n\r\n") * 3
    for step in (1, 2, 5, 1000):
        stream, found = warc.Stream("x"), []
        for k in range(0, len(data), step):
            found += stream.feed(data[k : k + step])
        stream.close()
        assert found == [record] * 3

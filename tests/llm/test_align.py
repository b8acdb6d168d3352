from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from atlasweave.llm import align, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def letters():
    """The byte of each letter that byte-level vocabularies write: printing Latin-1 as it is, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


def expected(rows):
    """Whole texts, each encoded as one, and plain loops over their tokens."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    of = letters()
    found, counts = [], Counter()
    for k, text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        x_bytes = [bytes(of[c] for c in a.id_to_token(t)) for t in x]
        y_bytes = [bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in y]
        if not text or b"".join(x_bytes) != (" " + text).encode() or b"".join(y_bytes) != (" " + text).encode():
            found.append((k, [], [], [], []))
            continue
        ends = [list(accumulate(map(len, s))) for s in (x_bytes, y_bytes)]
        at_b = dict(zip(ends[1], y, strict=True))
        links = [(t, at_b[e]) for t, e in zip(x, ends[0], strict=True) if e in at_b]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
            groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
            i, j = p, q
        counts.update(links)
        found.append((k, x, y, groups, links))
    most = Counter()
    for (_, q), n in counts.items():
        most[q] = max(most[q], n)
    return [(k, len(x), len(y), len(g), len(li), sum(counts[p] == most[p[1]] for p in li), sum(counts[p] for p in li), hashlib.sha256(";".join(g).encode()).hexdigest() if x else "") for k, x, y, g, li in found]


def texts():
    rng = random.Random(2)
    odd = ["", None, " ", "  ", "a", " a  b ", "a\nb\n\n  c", "▁", "a▁b", "a ▁ b", "<|endoftext|> <s></s> <0x41><unk>", "x" * 3000, "ab " * 3000, "żółw 𝄞 ﷺ  　  x", "\u0000a \u0000", "it's we'll 'S don’t", "é ‍👩‍👩‍👧", "१२३ ۴۵", "a\t b\r\n c", "﻿ a", " lead", "trail ", "\u0085 a \u0085b", "Ｆｕｌｌ ﬁ"]
    made = ["".join(rng.choices(["a", "the", " ", "  ", "\n", "é", "1", "'s", ".", "日", "\t", " ", "Word"], k=rng.randint(1, 40))) for _ in range(150)]
    return [*odd, *made]


@pytest.mark.parametrize("hot", [align.HOT, 5, 0])
def test_odd_texts_against_plain_loops(spark, monkeypatch, hot):
    monkeypatch.setattr(align, "HOT", hot)
    rows = list(enumerate(texts()))
    rows += [(5, rows[5][1]), (5, "another"), (None, "the word"), (None, "the word"), (None, None), (3, "the a▁b the")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("segment", F.lit(1)).withColumn("n", F.lit("x")).repartition(3)
    got = [tuple(r) for r in align.Alignment(df, A, B).per_text().collect()]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)


def test_no_texts(spark):
    assert align.Alignment(spark.createDataFrame([], "doc_id long, text string"), A, B).per_text().collect() == []
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in align.Alignment(only, A, B).per_text().collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_op12(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_alignment(spark, SF)
    assert got.columns == ["doc_id", *align.ZERO, "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(expected(rows))


def test_segments_of_a_text_are_not_compared_with_each_other(spark, monkeypatch):
    monkeypatch.setattr(align, "HOT", 3)
    rows = [(k // 2, " ".join(f"w{j % 40}" for j in range(400))) for k in range(4)]
    made = align.Alignment(spark.createDataFrame(rows, "doc_id long, text string"), A, B).per_text()
    assert sorted(map(tuple, made.collect())) == sorted(expected(rows))
    assert "array_distinct" not in made._jdf.queryExecution().analyzed().toString()


def test_tokens_are_dealt_out_as_one_number(spark):
    rows = spark.createDataFrame([(" the",), (" żółw",), (" \n",)], "segment string").withColumn("n", F.lit(1).cast("long"))
    made = align.encoded(rows, A, B)
    assert dict(made.dtypes)["a"] == dict(made.dtypes)["b"] == "array<int>"
    both = align.Tokenizers.get(A, B)
    for r in made.collect():
        for got, ids, table in ((r.a, both.encode_a([r.segment])[0], both.a_bytes), (r.b, both.encode_b([r.segment])[0], both.b_bytes)):
            assert [(x >> align.SIZE_BITS, x & (1 << align.SIZE_BITS) - 1) for x in got] == [(t, len(table[t])) for t in ids]


def test_rows_that_share_a_number_are_told_apart(spark, monkeypatch):
    """Numbers of eight bytes name texts in shuffles; where two texts share one, the next seed is taken."""
    number = align._number
    monkeypatch.setattr(align, "_number", lambda seed, *columns: F.lit(7).cast("long") if seed == 0 else number(seed, *columns))
    rows = [(1, "the word"), (2, "a word"), (2, "a word"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = align.Alignment(df, A, B)
    assert dict(made._keyed()[0].dtypes)["key"] == "bigint"
    assert sorted((tuple(r) for r in made.per_text().collect()), key=str) == sorted(expected(rows), key=str)


def test_small_numbers_travel_as_one(spark):
    rows = [(3, 2, 1, 1, 0, 9, "x"), (4095, 0, 7, 4095, 4095, 1 << 40, "y"), (4096, 1, 1, 5, 2, 0, "z")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in align.ZERO) + ", groups string")
    packed = align._packed(df)
    assert sorted((r.groups, r.small is None, r.n_a) for r in packed.collect()) == [("x", False, None), ("y", False, None), ("z", True, 4096)]
    assert sorted(map(tuple, align._unpacked(packed).select(df.columns).collect())) == sorted(rows)

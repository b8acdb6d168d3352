from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from atlasweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENS = bpe.read_ranks(PATH)
ENCODER = bpe.Encoder(TOKENS)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(TOKENS)}, special_tokens={})
PIECES = st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'stmdrevl.,1x²é 　\x1c日😀")), st.characters(exclude_categories=["Cs"])), max_size=40)


def encode(texts):
    ids, offsets = ENCODER.encode_batch(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=5))
def test_as_the_library(texts):
    assert encode(texts) == [REFERENCE.encode_ordinary(t) for t in texts]


def test_every_code_point():
    texts = [f"{chr(c)}a {chr(c)}{chr(c)} 1{chr(c)}" for c in [*range(0xD800), *range(0xE000, 0x3000 + 0x10000)]]
    got = []
    for i in range(0, len(texts), 5000):
        got += encode(texts[i : i + 5000])
    assert got == [REFERENCE.encode_ordinary(t) for t in texts]


def test_perfect_hash_is_minimal_and_exact():
    table = bpe.PerfectHash(TOKENS[:5000])
    import numpy as np

    buf = np.frombuffer(b"".join(TOKENS[:6000]) + bytes(8), np.uint8)
    length = np.array([len(t) for t in TOKENS[:6000]])
    start = np.cumsum(length) - length
    got = table.lookup(buf, start, length)
    assert got[:5000].tolist() == list(range(5000))
    assert (got[5000:] == -1).all()
    assert sorted(table.rank.tolist()) == list(range(5000))


def test_long_runs_merge():
    for piece in (b"a" * 3000, b" " * 500 + b"x", bytes(range(256)) * 3, b"z"):
        assert b"".join(TOKENS[k] for k in bpe.merge(piece, ENCODER.ranks)) == piece
    assert bpe.merge(b"hello", ENCODER.ranks) == REFERENCE.encode_ordinary("hello")


def test_round_trip_in_spark(spark):
    texts = [None, "", "Hello, it's  a\n\nlong " * 3000, "ж" * 999, "<|endoftext|>", " ", "same", "same"]
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, ids long")
    ids = bpe.encode(df, PATH)
    assert ids.columns == ["doc_id", "text", "ids", "token_ids"]
    rows = bpe.decode(ids, PATH).collect()
    for r in rows:
        assert r.token_ids == REFERENCE.encode_ordinary(r.text or "")
        assert r.decoded.decode() == (r.text or "")
    assert bpe.encode(df.limit(0), PATH).count() == 0
    assert bpe.encode(ids, PATH).columns == ids.columns
    nulls = bpe.decode(spark.createDataFrame([(None,), ([],)], "token_ids array<int>"), PATH).collect()
    assert sorted([r.decoded is None for r in nulls]) == [False, True]

from __future__ import annotations

from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from atlasweave.llm import bpe, queries, stages

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), "test")
        assert docs.columns == names
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0
    before = {r.doc_id: r.text for r in docs.collect()}
    copies = Counter(r.doc_id for r in docs.collect())
    assert max(copies.values()) <= 3
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in out) == copies
    assert all(r.token_ids == library.encode_ordinary(before[r.doc_id]) for r in out)


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, size int, id int"
    rows = [(1, None, None, None, None, None, None, None, None), (None, "", "en", "s", 0, 1.0, "k", 1, 1), (2, "A b c d e f. " * 40, "en", "s", 9, 2.0, "k", 2, 2), (2, "a b c d e f. " * 40, "en", None, 9, 2.0, "k", 2, 2)]
    df = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for table in (df, df.limit(0)):
            out = stage(spark, table, SF)
            assert out.columns == df.columns
            out.collect()
    assert stages.tokens(spark, df, SF).count() == 4
    ids = lambda stage: sorted((r.doc_id for r in stage(spark, df, SF).collect()), key=lambda i: (i is not None, i))
    assert ids(stages.exact_dedup) == [1, 2]  # the null id yields, and texts that differ in case are one
    assert ids(stages.near_dedup) == [None, 1, 2]  # texts without words stay
    assert ids(stages.mixing) == [2, 2]  # those without words are in no mix; two sources of one text each
    empty = {r.doc_id: (r.token_ids, r.n_tokens, r.decoded_sha256) for r in stages.tokens(spark, df, SF).collect()}
    assert empty[1] == empty[None] == ([], 0, "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")


def test_queries_run_with_whole_tables(spark):
    for name, rows in (("op4_secrets", "documents"), ("op5_pages", "pages")):
        assert queries.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{rows}.parquet").count()

"""The stages of the corpus pipeline: each takes and, but for the last, returns a table with the columns of documents.

Further columns pass, whatever their names. Null texts count as empty; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dedup, ngram_join, quality as classifier
from .common import fresh
from .mixing import mix

#: Documents scored lower are rejected.
LEAST_QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it is fitted on labelled ones among them.

    Null and empty texts are scored like any other, repeated rows alike. Without labels all have a score of 0.5 and go.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    sample = classifier.label_sample(labels).select(F.col("__id").alias("doc_id")).distinct()  # bounded, so it may be broadcast
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left_semi")
    trees = classifier.fit(classifier.measured(labelled), labels)
    score = fresh(docs, "score")
    return classifier.scored(docs, trees, out_col=score).filter(F.col(score) >= LEAST_QUALITY).drop(score)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one of the largest id; null and empty texts are one group; null ids yield to any other."""
    return dedup.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by sets of five-word shingles with a similarity of 0.8 or more, the one of the least id.

    Documents without words stay. A null id comes last; rows alike in id and text stay or go together.
    """
    return ngram_join.drop_near_duplicates(docs, width=5, num=80, den=100)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times, dealt to shards and shuffled in them.

    Documents without words are in no mix; a null source is one source, the last.
    """
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, token_ids, n_tokens, decoded_sha256) of each row: its ids, and the digest of what they decode to.

    A null or empty text has no ids and the digest of nothing; ids and sources pass as they are.
    """
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs.select("doc_id", "source", "text"), path, decoded_col="decoded").select("doc_id", "source", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))

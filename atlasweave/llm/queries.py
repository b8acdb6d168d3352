"""The registered queries of this subpackage: one for each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, bpe, codes, dedup, lm, mixing, ngram_join, pages, quality, secrets, toxicity, warc
from .common import crc_mod, stage_path


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids, and give digests of both."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe.encode(docs, path, decoded_col="decoded").select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group, the surviving id and the fate of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup.exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document; fitted where crc32 of the id leaves no 2 modulo 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stats = quality.measured(docs)
    trees = quality.fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return quality.scores(stats, trees).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document; fitted where crc32 of the id leaves no 0 modulo 5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return toxicity.scored(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digests of the spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return secrets.find_secrets(docs).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.joined("base"), 256).alias("base_sha256"),
        secrets.joined("spans").alias("spans"),
    )


def op5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return pages.main_texts(rows, out_col="text").withColumn("n_chars", F.length("text").cast("long"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = mixing.measured(docs, "doc_id", "text", "source", seed=0)
    return mixing.mix_sizes(sizes).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.size("draws") * F.col("size")).cast("long").alias("taken"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth id."""
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of 3-word sets with a similarity of 0.9 or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ngram_join.components(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and model scores of every document; fitted where crc32 of the id leaves no 1 modulo 5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model, vocab = lm.fit(docs)
    held = F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False))
    return lm.scored(docs, model, vocab).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every vector, with its error and its label's."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    rows, books = codes.compressed(vectors, "vec_id", "embedding")
    return codes.label_errors(rows, "label").select("vec_id", "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of a byte-level vocabulary and of one of pieces end together in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = align.Alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.per_text().withColumnRenamed("id", "doc_id")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, and read the archives back."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return warc.page_roles(rows, stage_path(spark, "archives"), least=0).withColumnRenamed("id", "page_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_exact_dedup, op3_quality, op4_secrets, op5_pages, op6_toxicity, op7_mixing, op8_nearest, op9_ngram_join, op10_lm_scores, op11_codes, op12_alignment, op13_warc)}


_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _codes_sql(rounds: int = 4) -> str:
    """Plain rounds over all pairs of parts and entries."""
    nearest = "SELECT vec_id, label, k, any_value(p.x) AS x, min(list_sum(list_transform(list_zip(p.x, c.x), lambda q: (q[1] - q[2]) * (q[1] - q[2])))::BIGINT * 256 + j) AS m FROM p JOIN c{r} c USING (k) GROUP BY vec_id, label, k"
    moved = "SELECT k, m % 256 AS j, pos, sum(x[pos])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 17) t(pos) GROUP BY ALL"
    entries = "SELECT c.k, c.j, coalesce(any_value(n.x), any_value(c.x)) AS x FROM c{r} c LEFT JOIN (SELECT k, j, list((s - (s % n + n) % n) // n ORDER BY pos) AS x FROM s{r} GROUP BY k, j) n USING (k, j) GROUP BY c.k, c.j"
    steps = [f"a{r} AS MATERIALIZED ({nearest.format(r=r)}), s{r} AS MATERIALIZED ({moved.format(r=r)}), c{r + 1} AS MATERIALIZED ({entries.format(r=r)})" for r in range(rounds)]
    return f"""
        WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT vec_id, label, k, e[k * 16 + 1 : k * 16 + 16] AS x FROM v, range(4) t(k)),
        c0 AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS j, x FROM p QUALIFY j < 256),
        {", ".join(steps)},
        f AS MATERIALIZED ({nearest.format(r=rounds)}),
        r AS (SELECT vec_id, label, string_agg(printf('%02x', (m % 256)::INT), '' ORDER BY k) AS code, sum(m // 256)::BIGINT AS error FROM f GROUP BY vec_id, label)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY k, j)) FROM c{rounds}) AS codebooks_sha256
        FROM r"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_codes": _codes_sql(),
        "op2_exact_dedup": f"""
            WITH n AS (SELECT doc_id, {_NORM} AS norm FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
            FROM n WINDOW w AS (PARTITION BY norm)""",
        "op8_nearest": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
                       WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                         AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
            d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[2] - p[1]) * (p[2] - p[1])))) AS score
                  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
            SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10""",
        "op13_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS body, lower(sha1(coalesce(html, ''))) AS hex FROM pages),
            f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM p)
            SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
                   array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       (('0x' || substr(hex, (k // 4)::INT * 5 + 1, 5))::BIGINT >> (15 - 5 * (k % 4))::INT)::INT % 32 + 1, 1)), '') AS payload_digest,
                   CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
            FROM f""",
    }

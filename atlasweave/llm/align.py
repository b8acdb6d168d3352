"""Alignment of two tokenizers over the same texts: where tokens of both end together, and which pairs end together how often.

Texts are made of segments that neither tokenizer's tokens reach across: both cut before a space that follows something else
(`Tokenizers` checks that theirs do, else a text is one segment). So the tokens of a text are those of its segments, and the
distinct segments of a corpus, few beside its words, are aligned once:

1. segments are counted, with partial counts before the shuffle, and each distinct one is encoded by both tokenizers;
2. tokens are rows (posexplode), their ends cumulative lengths (a window by position); both sides meet in a join on segment
   and end, and the running count of ends that both have numbers the groups (a window by end);
3. pairs that end together are counted over the corpus, a segment's as often as it occurs;
4. each text takes the rows of its segments: those of the most frequent segments, of which there are HOT at most and none
   is longer than LONG, are broadcast, so no frequent word meets in one task; the others are joined by segment.

Texts that are null or empty have no tokens. Where the tokens' bytes are not those of the text (a tokenizer that normalises,
or writes U+2581 for a space), a text as a whole has none, and its segments don't count for others. Rows with equal ids and
texts are one row with its copies; null ids are ids like others. Further columns don't pass.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, map_arrow, slices, staged

#: Segments, and pairs, that may be broadcast, and the longest description of a segment that is.
HOT, LONG = 131_072, 256
#: White space of any tokenizer, and what is not surely something else; a text is cut between another character and a space.
_SPACES = r"\s\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁯▁　﻿"
CUT = f"(?= )(?<=[^{_SPACES}])"
#: Bytes of texts in a partition where texts are dealt by id.
DEALT = 4 << 20
#: Rows that come in order of their key are aggregated in that order; texts of a partition, which are few, without sorting their segments.
IN_ORDER = {"spark.sql.execution.useObjectHashAggregateExec": "false"}
HELD = {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": str(1 << 14)}

#: A token and its bytes are one number: what is dealt out is mostly these. A table whose token has more bytes is not taken.
SIZE_BITS = 12
ENCODED = "segment string, n long, a array<int>, b array<int>, same boolean"
ZERO = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

#: Those that are mostly small: rows of segments carry them through a shuffle as one.
SMALL = ZERO[:5]

_loaded: dict[tuple[str, str], Tokenizers] = {}


class Tokenizers:
    """A byte-level BPE (A) and a sentence-piece model that adds a space before a text (B)."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        marks = {c: byte for byte, c in _byte_letters(sorted(pre_tokenizers.ByteLevel.alphabet())).items()}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.a_bytes[k] = bytes(marks[c] for c in token) if all(c in marks for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.b_space = self.b.piece_to_id("▁")
        said = json.loads(open(a_path, encoding="utf-8").read())
        before = said.get("pre_tokenizer") or {}
        plain = said.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        self.cuts = plain and not any("▁" in p.lstrip("▁") for p in pieces) and self.b.encode("a  b ") == [*self.b.encode("a"), *self.b.encode(" b"), self.b_space]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in table], np.int32) for table in (self.a_bytes, self.b_bytes))
        if max(self.a_sizes.max(), self.b_sizes.max()) >> SIZE_BITS or max(len(self.a_sizes), len(self.b_sizes)) >> 31 - SIZE_BITS:
            raise ValueError("a token's bytes or a table's tokens are too many")

    @classmethod
    def get(cls, a_path: str, b_path: str) -> Tokenizers:
        if (a_path, b_path) not in _loaded:
            _loaded[a_path, b_path] = cls(a_path, b_path)
        return _loaded[a_path, b_path]

    def encode_a(self, segments: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]

    def encode_b(self, segments: list[str]) -> list[list[int]]:
        """The model adds the space that a segment begins with."""
        return [ids or [self.b_space] for ids in self.b.encode([s[1:] for s in segments], num_threads=1)]


def _byte_letters(alphabet: list[str]) -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it is in the alphabet, else the next beyond Latin-1."""
    own = {ord(c): c for c in alphabet if ord(c) < 256}
    rest = iter(c for c in alphabet if ord(c) >= 256)
    return own | {byte: next(rest) for byte in range(256) if byte not in own}


def pieces(text: Column, cuts: bool) -> Column:
    """The segments of a space and a text."""
    whole = F.concat(F.lit(" "), text)
    return F.split(whole, CUT) if cuts else F.array(whole)


def _tokens(ids: list[list[int]], sizes: np.ndarray) -> pa.Array:
    flat = np.fromiter((t for x in ids for t in x), np.int32)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat << SIZE_BITS | sizes[flat]))


def _same(segments: list[str], ids: list[list[int]], table: list[bytes]) -> np.ndarray:
    """Whether the bytes of each segment's tokens are its own."""
    return np.array([b"".join([table[t] for t in x]) == s.encode() for s, x in zip(segments, ids, strict=True)], bool)


def encoded(counts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Distinct segments (segment, n) with the tokens of both and whether their bytes are the segment's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers.get(a_path, b_path)
        for batch in slices(batches, "segment", 1 << 18):
            segments = batch.column(0).to_pylist()
            a, b = both.encode_a(segments), both.encode_b(segments)
            same = _same(segments, a, both.a_bytes) & _same(segments, b, both.b_bytes)
            yield pa.record_batch([batch.column(0), batch.column(1), _tokens(a, both.a_sizes), _tokens(b, both.b_sizes), pa.array(same)], names=[x.split()[0] for x in ENCODED.split(", ")])

    return map_arrow(counts, run, ENCODED)


def _ends(rows: DataFrame, side: str) -> DataFrame:
    """(id, end, side): tokens as rows, with the byte at which each ends."""
    tokens = rows.select("id", F.posexplode(side).alias("pos", "token"))
    end = F.sum(F.col("token").bitwiseAND((1 << SIZE_BITS) - 1)).over(Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return tokens.select("id", end.cast("int").alias("end"), F.shiftright("token", SIZE_BITS).alias(side))


def aligned(segments: DataFrame) -> DataFrame:
    """(id, n_groups, groups, links) of segments (id, a, b): the groups as text, and the pairs that end together."""
    both = _ends(segments, "a").join(_ends(segments, "b"), ["id", "end"], "full")
    cut = F.col("a").isNotNull() & F.col("b").isNotNull()
    before = Window.partitionBy("id").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    rows = both.withColumn("grp", F.coalesce(F.count(F.when(cut, 1)).over(before), F.lit(0)))
    listed = lambda c: F.expr(f"listagg(CAST({c} AS STRING), ',') WITHIN GROUP (ORDER BY end)")
    groups = rows.groupBy("id", "grp").agg(F.concat_ws("|", listed("a"), listed("b")).alias("text"), F.max(F.when(cut, F.struct("a", "b"))).alias("link"))
    return groups.groupBy("id").agg(F.count("*").alias("n_groups"), F.expr("listagg(text, ';') WITHIN GROUP (ORDER BY grp)").alias("groups"), F.collect_list("link").alias("links"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, count, best) of segments (n, links): how many links of the corpus hold a pair, and whether no other pair of its b has more."""
    counted = rows.filter("n > 0").select("n", F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.sum("n").alias("count"))
    return counted.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def _frequent(rows: DataFrame, column: str) -> int:
    """The least count at which no more than HOT rows are as frequent."""
    bins = rows.filter(F.col(column) > 0).groupBy(F.floor(F.log2(column) * 8).alias("bin")).agg(F.count("*").alias("size"), F.min(column).alias("least")).collect()  # some hundreds at most
    least, total = 1 << 62, 0
    for r in sorted(bins, key=lambda r: -r.bin):
        total += r["size"]
        if total > HOT:
            break
        least = r.least
    return least


def _number(seed: int, *columns: Column) -> Column:
    """A number of eight bytes, which a row's segments carry through shuffles. Where rows that differ share one, another seed is tried."""
    return F.xxhash64(F.lit(seed), *columns)


def _packed(segments: DataFrame) -> DataFrame:
    """Segments with the numbers of SMALL in one (small), where each has 12 bits at most; where not, small is null and they stay."""
    fits = F.greatest(*[F.col(c) for c in SMALL]) < 1 << 12
    bits = sum((F.col(c) * (1 << 12 * k) for k, c in enumerate(SMALL)), F.lit(0).cast("long"))
    return segments.withColumns({"small": F.when(fits, bits), **{c: F.when(~fits, F.col(c)) for c in SMALL}})


def _unpacked(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.coalesce(c, F.shiftright("small", 12 * k).bitwiseAND(F.lit((1 << 12) - 1))) for k, c in enumerate(SMALL)}).drop("small")


class Alignment:
    """What a corpus says of two tokenizers: `segments` (segment, n, ZERO columns, groups, or bad), `pairs` (a, b, count, best)."""

    def __init__(self, docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.cuts = Tokenizers.get(a_path, b_path).cuts
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        full = self.docs.filter("text <> ''")
        words = full.select(F.explode(pieces(F.col("text"), self.cuts)).alias("segment"))
        found = encoded(words.groupBy("segment").agg(F.count("*").alias("n")), a_path, b_path)
        known = staged(found.withColumn("id", F.monotonically_increasing_id()), "segments")  # written, so that ids stay
        bad = known.filter("NOT same").select("segment")
        if not bad.isEmpty():  # texts that can't be aligned are left out of all counts
            texts = full.withColumn("segment", F.explode(pieces(F.col("text"), self.cuts)))
            spoilt = texts.join(bad, "segment", "left_semi").select(F.col("id").alias("bad_id"), F.md5("text").alias("bad_key")).distinct()
            sound = full.join(spoilt, F.col("id").eqNullSafe(F.col("bad_id")) & (F.md5("text") == F.col("bad_key")), "left_anti")
            counts = sound.select(F.explode(pieces(F.col("text"), self.cuts)).alias("segment")).groupBy("segment").agg(F.count("*").alias("n"))
            recounted = staged(known.drop("n").join(counts, "segment", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))), "segments")
            discard(known)
            known = recounted
        sound = known.filter("same")
        rows = staged(aligned(sound.select("id", "a", "b").repartition("id")), "aligned", IN_ORDER)
        self.pairs = staged(pair_counts(rows.select("id", "links").join(sound.select("id", "n").filter("n <> 1"), "id", "left").select(F.coalesce("n", F.lit(1).cast("long")).alias("n"), "links")), "pairs")
        linked = rows.select("id", F.explode("links").alias("l")).select("id", "l.a", "l.b")
        often = F.col("count") >= _frequent(self.pairs, "count")
        hot = F.broadcast(self.pairs.filter(often))
        seldom = linked.join(hot, ["a", "b"], "left_anti").join(self.pairs.filter(~often), ["a", "b"])
        each = linked.join(hot, ["a", "b"]).unionByName(seldom)  # the links of a segment are summed before they are dealt out
        sums = each.groupBy("id").agg(F.count("*").alias("n_links"), F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
        sizes = sound.select("id", "segment", "n", F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b"))
        whole = sizes.join(rows.drop("links"), "id").join(sums, "id", "left").na.fill(0, ["n_links", "n_best", "count_sum"])
        self.segments = staged(whole.select("segment", "n", *ZERO, "groups", F.lit(False).alias("bad")).unionByName(known.filter("NOT same").select("segment", "n", *[F.lit(0).cast("long").alias(c) for c in ZERO], F.lit("").alias("groups"), F.lit(True).alias("bad"))), "described")
        discard(known, rows)

    def per_text(self) -> DataFrame:
        """(id, ZERO columns, groups_sha256) of every row."""
        frequent = (F.col("n") >= _frequent(self.segments, "n")) & (F.length("groups") <= LONG) & (F.length("segment") <= LONG)
        what = [*ZERO, "groups", "bad"]
        hot = F.broadcast(self.segments.filter(frequent).select("segment", *what))
        rare = self.segments.filter(~frequent).select("segment", *what)
        keyed, bytes_ = self._keyed()
        summed = [*[F.sum(c).alias(c) for c in ZERO], F.max("bad").alias("bad"), F.collect_list(F.when(F.col("groups").isNotNull(), F.struct("pos", "groups"))).alias("found")]
        words = F.posexplode(pieces(F.col("text"), self.cuts)).alias("pos", "segment")
        others = keyed.filter("text <> ''").select("key", words).join(hot, "segment", "left_anti")
        met = others.join(_packed(rare).hint("shuffle_hash"), "segment").drop("segment").repartition("key")  # few of a text's rare segments meet in a task before
        tails = staged(_unpacked(met).groupBy("key").agg(*summed), "tails", HELD)  # a row's copies are in it more than once
        texts = keyed.repartition(bytes_ // DEALT + 1, "key").groupBy("key").agg(F.first("id").alias("id"), F.count("*").alias("copies"), F.first("text").alias("text"))
        listed = texts.select("key", "id", "copies", F.posexplode_outer(F.when(F.col("text") != "", pieces(F.col("text"), self.cuts))).alias("pos", "segment"))
        heads = listed.join(hot, "segment", "left").groupBy("key").agg(F.first("id").alias("id"), F.first("copies").alias("copies"), *summed)  # by the dealt key: no shuffle
        joined = heads.join(tails.select("key", *[F.col(c).alias(f"r_{c}") for c in (*ZERO, "bad", "found")]), "key", "left")
        number = lambda c: F.coalesce(F.col(c), F.lit(0)) + F.floor(F.coalesce(F.col(f"r_{c}"), F.lit(0)) / F.col("copies"))
        bad = F.coalesce(F.col("bad"), F.lit(False)) | F.coalesce(F.col("r_bad"), F.lit(False))
        none = F.array().cast("array<struct<pos:int,groups:string>>")
        once = F.filter(F.array_sort(F.coalesce("r_found", none)), lambda _, i: i % F.col("copies") == 0)  # each row is in it for each copy
        ordered = F.array_sort(F.concat(F.coalesce("found", none), once))
        text = F.array_join(F.transform(ordered, lambda x: x["groups"]), ";")
        shown = joined.select("id", "copies", bad.alias("spoilt"), *[F.when(bad, 0).otherwise(number(c)).cast("long").alias(c) for c in ZERO], F.when(bad | (F.size(F.coalesce("found", none)) + F.size(F.coalesce("r_found", none)) == 0), "").otherwise(F.sha2(text, 256)).alias("groups_sha256"))
        each = shown.select("id", *ZERO, "groups_sha256", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
        found = staged(each, "texts", HELD)
        discard(tails)
        return found

    def _keyed(self) -> tuple[DataFrame, int]:
        """Rows with a number (key) that only rows alike in id and text share, and the bytes of all texts."""
        named = F.coalesce(F.concat(F.lit("id:"), F.col("id").cast("string")), F.lit("null"))
        for seed in range(64):
            keyed = self.docs.withColumn("key", _number(seed, named, F.col("text")))
            digests = keyed.select("key", F.md5(F.concat_ws("\n", named, "text")).alias("md5"), F.octet_length("text").alias("size"))
            of = digests.groupBy("key").agg(F.min("md5").alias("x"), F.max("md5").alias("y"), F.sum("size").alias("size"))
            check = of.agg(F.count_if(F.col("x") != F.col("y")).alias("shared"), F.sum("size").alias("size")).first()
            if not check["shared"]:
                break
        return keyed, int(check["size"] or 0)

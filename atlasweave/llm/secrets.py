"""Secret scanning: fixed patterns, and a battery of randomness tests over other runs that look encoded.

Each candidate run gets an encoding by the characters it uses. Under the hypothesis that it is random in that encoding,
a chi-squared test of a uniform alphabet, a runs test and a lag-one serial correlation test give p-values, joined by
Bonferroni's rule. Over the whole corpus, within each encoding and class of length, the Benjamini-Hochberg procedure
decides which candidates are no random strings; the others are reported. An encoding has a least length, below which the
tests could not tell text from secrets. A run that no encoding holds, as it mixes + or / with - or _, is tested in parts;
parts overlap where one reading of the run takes in more than another, and so may the spans reported of it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import map_arrow, slices, staged

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_HINTS = ("passw", "secret", "token", "api")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: Readings of a run that no encoding holds: maximal parts in base64, in base64url, and between any of the four marks.
_PARTS = tuple(re.compile(x) for x in (r"[A-Za-z0-9+/]+", r"[A-Za-z0-9_-]+", r"[A-Za-z0-9]+"))
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings from the narrowest: name, alphabet in order, least length.
ENCODINGS = (
    ("hex", _DIGITS + "abcdef", 24),
    ("hex_upper", _DIGITS + "ABCDEF", 24),
    ("lower", _LOWER, 64),
    ("upper", _UPPER, 64),
    ("base32", _UPPER + "234567", 24),
    ("base36", _DIGITS + _LOWER, 24),
    ("base62", _DIGITS + _UPPER + _LOWER, 20),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/", 20),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_", 20),
)
_SETS = [(k, {c: i for i, c in enumerate(alphabet)}, least) for k, (_, alphabet, least) in enumerate(ENCODINGS)]
#: Upper ends of the classes of length.
LENGTHS = (32, 48, 96)
#: Share of random strings that may be taken for text.
FALSE_DISCOVERIES = 0.05
_BINS = 10_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping within each kind."""
    found = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    low = text.lower()
    if any(hint in low for hint in _HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    return sorted(found)


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(symbols: list[int], size: int) -> float:
    """The p-value, by Bonferroni's rule over three tests, of symbols drawn evenly and independently from size ones."""
    n = len(symbols)
    bins = max(3, min(size, n // 5))
    counts, expected = [0] * bins, [0.0] * bins
    for s in range(size):
        expected[s * bins // size] += n / size
    for s in symbols:
        counts[s * bins // size] += 1
    chi = sum((c - e) ** 2 / e for c, e in zip(counts, expected, strict=True))
    k = bins - 1
    uniform = _tail(((chi / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))
    high = [s * 2 >= size for s in symbols]
    a = sum(high)
    b = n - a
    if a and b:
        runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
        mean = 1 + 2 * a * b / n
        spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        turns = 2 * _tail(abs(runs - mean) / spread)
    else:
        turns = 2.0 ** (1 - n)
    mean = sum(symbols) / n
    power = sum((s - mean) ** 2 for s in symbols)
    serial = 2 * _tail(abs(sum((x - mean) * (y - mean) for x, y in zip(symbols, symbols[1:], strict=False)) / power) * math.sqrt(n)) if power else 0.0
    return min(1.0, 3 * min(uniform, turns, serial))


def _candidate(run: str, start: int) -> tuple[int, int, int, int] | None:
    """What candidates gives of a run in one encoding; None if it is too short for it."""
    used = set(run)
    for k, index, least in _SETS:
        if used <= index.keys():
            if len(run) < least:
                return None
            p = battery([index[c] for c in run], len(index))
            return start, start + len(run), k * 4 + sum(len(run) >= x for x in LENGTHS), min(int(p * _BINS), _BINS - 1)
    return None


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, stratum, bin of the p-value) of runs outside the fixed patterns; the stratum names encoding and length."""
    out = []
    for m in _RUN.finditer(text):
        run, at = m[0], m.start()
        mixed = ("+" in run or "/" in run) and ("-" in run or "_" in run)
        parts = sorted({x.span() for part in _PARTS for x in part.finditer(run)}) if mixed else [(0, len(run))]
        for start, end in parts:
            if any(s <= at + start and at + end <= e for s, _, e in base):
                continue
            found = _candidate(run[start:end], at + start)
            if found:
                out.append(found)
    return out


_SPAN = T.ArrayType(T.StructType([T.StructField(x, T.IntegerType()) for x in ("start", "kind", "end")]))
_CANDIDATE = T.ArrayType(T.StructType([T.StructField(x, T.IntegerType()) for x in ("start", "end", "stratum", "bin")]))


def _scan(df: DataFrame, text_col: str) -> DataFrame:
    kept = [f for f in df.schema.fields if f.name != text_col]
    names = [f.name for f in kept]
    span = pa.list_(pa.struct([(x, pa.int32()) for x in ("start", "kind", "end")]))
    candidate = pa.list_(pa.struct([(x, pa.int32()) for x in ("start", "end", "stratum", "bin")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            base, more = [], []
            for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                found = base_spans(text or "")
                base.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in found])
                more.append([dict(zip(("start", "end", "stratum", "bin"), x, strict=True)) for x in candidates(text or "", found)])
            columns = [batch.column(batch.schema.get_field_index(x)) for x in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(base, span), pa.array(more, candidate)], [*names, "base", "candidates"])

    return map_arrow(df, run, T.StructType([*kept, T.StructField("base", _SPAN), T.StructField("candidates", _CANDIDATE)]))


def find_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df without its text, with base and spans: arrays of (start, kind, end) by start, kind as numbered in KINDS.

    Positions count code points, ends are exclusive. Null counts as empty, an empty text has none; columns named base,
    candidates or spans give way. Strata are few (encodings times classes of length), so their thresholds are plain
    numbers in the plan.
    """
    scanned = staged(_scan(df.drop("base", "candidates", "spans"), text_col), "secrets")
    each = scanned.select(F.explode("candidates").alias("c")).groupBy("c.stratum", "c.bin").count()
    upto = Window.partitionBy("stratum").orderBy("bin")
    whole = Window.partitionBy("stratum")
    steps = each.withColumn("upto", F.sum("count").over(upto)).withColumn("all", F.sum("count").over(whole))
    passing = steps.filter((F.col("bin") + 1) / _BINS <= FALSE_DISCOVERIES * F.col("upto") / F.col("all"))
    limits = {r["stratum"]: r["most"] for r in passing.groupBy("stratum").agg(F.max("bin").alias("most")).collect()}
    pairs = [F.lit(x) for item in sorted(limits.items()) for x in item]
    limit = F.create_map(*pairs) if pairs else None

    def random(c: Column) -> Column:
        return c["bin"] > F.coalesce(limit[c["stratum"]], F.lit(-1)) if limit is not None else F.lit(True)

    added = F.transform(F.filter("candidates", random), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return scanned.withColumn("spans", F.array_sort(F.concat("base", added))).drop("candidates")


def joined(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")

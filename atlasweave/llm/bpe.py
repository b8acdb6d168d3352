"""Byte-level BPE: a minimal perfect hash for pre-tokens that are in the vocabulary, a heap over linked bytes for the rest.

Pre-tokens are cut for a whole batch at once: each code point has a class (letter, number, space, other), and the
pattern's rules become comparisons of neighbouring classes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_arrow, mix, same_spans, slices, span_hash, utf8

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Merged pre-tokens kept by a worker in each of two generations.
CACHE = 200_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of rank."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    table = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [table[k] for k in range(len(table))]


class PerfectHash:
    """Maps n byte strings onto 0..n-1 without gaps; levels of bit arrays, each keeping the keys that are alone in their slot.

    lookup() gives the rank of each byte range, -1 where the range is no key: the key found is compared in full.
    """

    def __init__(self, keys: list[bytes]):
        self.length = np.array([len(k) for k in keys], np.int64)
        joined = np.frombuffer(b"".join(keys) + bytes(8), np.uint8)
        start = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64)
        hashes = span_hash(joined, start, self.length)
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        todo, taken, slot_of = np.arange(len(keys)), 0, np.zeros(len(keys), np.int64)
        while len(todo):
            size = max(64, 2 * len(todo))
            at = self._slot(hashes[todo], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = np.cumsum(alone) - alone
            good = alone[at]
            slot_of[todo[good]] = taken + rank[at[good]]
            self.levels.append((taken, alone, rank))
            taken += int(alone.sum())
            todo = todo[~good]
            if len(self.levels) > 64:
                raise ValueError("two keys are equal")
        self.rank = np.zeros(len(keys), np.int64)
        self.rank[slot_of] = np.arange(len(keys))
        self.start, self.bytes = start, joined

    @staticmethod
    def _slot(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(hashes + np.uint64(level * 0x632BE59BD9B4E019 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def lookup(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.full(len(start), -1, np.int64)
        short = np.flatnonzero(length <= self.length.max())
        hashes, live = span_hash(buf, start[short], length[short]), short
        for level, (taken, alone, rank) in enumerate(self.levels):
            at = self._slot(hashes, level, len(alone))
            hit = alone[at]
            out[live[hit]] = self.rank[taken + rank[at[hit]]]
            live, hashes = live[~hit], hashes[~hit]
            if not len(live):
                break
        found = np.flatnonzero(out >= 0)
        key = out[found]
        same = self.length[key] == length[found]
        left = self._words(self.bytes)
        right = self._words(buf)
        for k in range(int(self.length.max() + 7) // 8):
            rest = np.flatnonzero(same & (length[found] > 8 * k))
            if not len(rest):
                break
            mask = np.minimum(length[found[rest]] - 8 * k, 8)
            same[rest] = ((left[self.start[key[rest]] + 8 * k] ^ right[start[found[rest]] + 8 * k]) & self._masks[mask]) == 0
        out[found[~same]] = -1
        return out

    _masks = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)

    @staticmethod
    def _words(buf: np.ndarray) -> np.ndarray:
        return np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: its bytes are linked both ways, and a heap gives the pair of least rank, leftmost first."""
    n = len(piece)
    m = n + 1
    get, push, pop = ranks.get, heapq.heappush, heapq.heappop
    end = list(range(1, m))  # where the part that starts here ends; 0: merged away
    before = list(range(-1, n - 1))
    heap = []  # (rank, start, end) of a pair in one number, so that comparing is cheap
    for i in range(n - 1):
        if (rank := get(piece[i : i + 2])) is not None:
            heap.append((rank * m + i) * m + i + 2)
    heapq.heapify(heap)
    while heap:
        key, stop = divmod(pop(heap), m)
        i = key % m
        j = end[i]
        if not j or j >= n or end[j] != stop:  # one of the two has changed since
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (new := get(piece[i : end[stop]])) is not None:
                push(heap, (new * m + i) * m + end[stop])
        if (p := before[i]) >= 0 and (new := get(piece[p:stop])) is not None:
            push(heap, (new * m + p) * m + stop)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point, by the regular-expression library's own properties."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = np.arange(0x110000, dtype="<u4")
    every = np.delete(points, np.s_[0xD800:0xE000]).tobytes().decode("utf-32-le")  # no object for each
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        for m in regex.finditer(pattern + "+", every):
            for a, b in ((m.start(), m.end()),):
                lo, hi = ord(every[a]), ord(every[b - 1])
                table[lo : hi + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


def pretokens(points: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Positions at which a pre-token begins, for code points of texts that begin at the positions in begin.

    The rules of public_tokenizers.PATTERN: contractions, then runs of letters, of numbers or of others, each with one
    leading space, then white space, whose last character is left to what follows.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[begin[begin < n]] = True
    first[n] = True
    change = first[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    cut = change.copy()
    # In a run of white space before something solid of the same text, the last character stands alone or leads on.
    solid = kind != SPACE
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == SPACE) & solid[1:] & ~first[1:n]
    cut |= last
    led = np.flatnonzero(last & (points == 32)) + 1  # runs that take the space before them
    cut[led] = False
    # Contractions: an apostrophe that begins a token, alone among others, before s t m d re ve ll.
    at = np.flatnonzero((points == 39) & cut & change)
    at = at[(at + 1 < n)]
    at = at[~first[at + 1]]
    one = np.isin(points[at + 1], np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
    room = np.flatnonzero(~one & (at + 2 < n))
    room = room[~first[at[room] + 2]]
    a, b = points[at[room] + 1], points[at[room] + 2]
    two = room[((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))]
    for which, width in ((np.flatnonzero(one), 2), (two, 3)):
        start = at[which]
        cut[start + 1] = False
        after = start + width
        after = after[after < n]
        cut[after] |= (kind[after] == LETTER) & ~first[after]
    return np.flatnonzero(cut)


class Encoder:
    """Holds the vocabulary; encode_batch() turns texts into ids."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.table = PerfectHash(tokens)
        self.ranks = {t: k for k, t in enumerate(tokens)}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode_batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column, and the n + 1 offsets of its texts among them."""
        buf, offsets = utf8(column)
        n = int(offsets[-1])
        body = buf[:n]
        lead = np.flatnonzero((body & 0xC0) != 0x80)  # the byte at which each code point begins
        points = np.frombuffer(body.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        start = lead[pretokens(points, np.searchsorted(lead, offsets[:-1]))]
        length = np.diff(np.append(start, n))
        rank = self.table.lookup(buf, start, length)
        missing = np.flatnonzero(rank < 0)
        count = np.ones(len(start), np.int64)
        if len(missing):
            a, size = start[missing], length[missing]
            _, first, which = np.unique(span_hash(buf, a, size), return_index=True, return_inverse=True)
            if not same_spans(buf, a, a[first][which], size, size[first][which]):  # two pre-tokens with one hash
                first = which = np.arange(len(missing))
            pieces = self._merged(body.tobytes(), a[first].tolist(), (a + size)[first].tolist())
            flat = np.frombuffer(b"".join(pieces), np.int32)
            parts = np.array([len(x) // 4 for x in pieces], np.int64)
            begin = np.cumsum(parts) - parts
            count[missing] = parts[which]
        place = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(place[-1], np.int32)
        whole = rank >= 0
        out[place[:-1][whole]] = rank[whole]
        if len(missing):
            size = count[missing]
            inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(place[:-1][missing], size) + inner] = flat[np.repeat(begin[which], size) + inner]
        return out, place[np.searchsorted(start, offsets)]

    def forget(self) -> None:
        """Give up the pieces kept."""
        self.young, self.old = {}, {}

    def _merged(self, raw: bytes, starts: list[int], stops: list[int]) -> list[bytes]:
        """The ids of each piece as packed 32-bit numbers; pieces seen lately are kept in two generations."""
        out, young, old = [], self.young, self.old
        for a, b in zip(starts, stops, strict=True):
            piece = raw[a:b]
            ids = young.get(piece)
            if ids is None:
                ids = old.get(piece)
                if ids is None:
                    ids = array("i", merge(piece, self.ranks)).tobytes()
                if b - a < 100:
                    if len(young) >= CACHE:
                        young, old = {}, young
                        self.young, self.old = young, old
                    young[piece] = ids
            out.append(ids)
        return out


_encoders: dict[bytes, Encoder] = {}


def _encoder(tokens: list[bytes]) -> Encoder:
    """One encoder for a vocabulary in each worker, the latest one."""
    key = hashlib.sha256(b"".join(len(t).to_bytes(4, "little") + t for t in tokens)).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokens)
    return _encoders[key]


def _id_lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", out_col: str = "token_ids", decoded_col: str | None = None) -> DataFrame:
    """Add out_col, the ids of the whole text, by the rank file at vocabulary; no special tokens, null counts as empty.

    With decoded_col, also add what decode() makes of the ids, in the same pass. An empty text gives an empty array. Other
    columns pass; those named like the new ones give way. No shuffle: each batch is encoded where it is read, a few MB at a
    time, so long texts need no more than their own size.
    """
    df = df.drop(out_col, *[c for c in [decoded_col] if c])
    held = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held.value)
        for batch in slices(batches, text_col, 1_000_000):
            ids, offsets = encoder.encode_batch(batch.column(batch.schema.get_field_index(text_col)))
            made, names = [_id_lists(ids, offsets)], [out_col]
            if decoded_col:
                made, names = [*made, decode_batch(held.value, ids, np.diff(offsets))], [*names, decoded_col]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])
        encoder.forget()  # workers live on after a task

    fields = [T.StructField(out_col, T.ArrayType(T.IntegerType(), True)), *[T.StructField(c, T.BinaryType(), True) for c in [decoded_col] if c]]
    return map_arrow(df, run, T.StructType([*df.schema.fields, *fields]))


def decode_batch(tokens: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The bytes of consecutive lists of ids, of the given sizes."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(tokens)):
        raise ValueError("an id is outside the vocabulary")
    parts = [tokens[k] for k in ids.tolist()]
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(parts))]).cast(pa.binary())


def decode(df: DataFrame, vocabulary: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Add out_col, the bytes of the ids; a null array gives null, an id outside the vocabulary fails the job. A column named like it gives way."""
    df = df.drop(out_col)
    held = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                column = part.column(part.schema.get_field_index(ids_col))
                sizes = np.where(column.is_null(), 0, column.value_lengths().fill_null(0)).astype(np.int64)
                made = decode_batch(held.value, column.flatten().to_numpy(zero_copy_only=False), sizes)
                if column.null_count:
                    made = pa.compute.if_else(column.is_null(), pa.scalar(None, pa.binary()), made)
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, out_col])

    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.BinaryType(), True)])
    return map_arrow(df, run, schema)

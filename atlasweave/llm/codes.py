"""Short codes for vectors: parts of vectors replaced by the nearest of a few entries, found by Lloyd's rounds with heaps.

Vectors are packed into blocks, a row of a table each, and a block keeps its heaps from round to round: for each entry of each
part position one heap of the parts that are assigned to it. A part's key is its slack, what lies between the lower bound of
its distance to any other entry and the upper bound of the distance to its own, plus how far its entry's bounds had drifted
when it was pushed. When entries move, nothing is done to parts: an entry's drift grows by its own move and the largest move
of any other, and only parts whose key the drift has reached are popped, compared with all entries exactly, and pushed again.
Distances are of integers and exact, so the bounds leave out no part that could change, ties included, and results are those
of plain rounds.

What a round gathers are the sums of the parts that have changed their entry, added up in a task before they are shuffled;
codebooks and sums are of a fixed size (entries times width) and pass through the driver. Blocks are written after each
round, so a lost executor costs its tasks only. A block has BLOCK vectors at most, whatever a task reads.

Odd input: vectors that are null, or hold null or non-finite components, are left out. Vectors that are shorter than others,
empty ones too, are filled up with zeros, to a width that the number of parts divides. Rows of equal ids, and null ids, which
come last, are ordered by their vectors where the first entries are chosen; all rows are kept. With fewer rows than entries,
codebooks are as long as there are rows. Components must stay below 2**28 after scaling, else it is an error. Further columns
pass; those named as an output are displaced.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors in a block, and in a step of comparisons.
BLOCK, STEP = 16_384, 4_096
#: Added to bounds for what floating-point roots may be off; it costs comparisons, never results.
MARGIN = 1e-6
LARGEST = 1 << 28

STATE = "vectors binary, labels binary, sizes binary, members binary, keys binary, moved array<long>"


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """Components as integers."""
    made = np.floor(scale * values.astype(np.float64))
    if made.size and np.abs(made).max() >= LARGEST:
        raise ValueError(f"a component is {LARGEST} or more after scaling")
    return made.astype(np.int32)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each part the first of the nearest entries, and the squared distances of that and of the nearest other one, exactly."""
    most = max(int(np.abs(x).max(initial=0)) for x in (parts, book))
    small = 4 * most * most * max(parts.shape[1], 1) < 1 << 53
    kind = np.float64 if small else np.int64
    b = book.astype(kind)
    at, own, other = np.zeros(len(parts), np.int64), np.zeros(len(parts)), np.full(len(parts), np.inf)
    for k in range(0, len(parts), STEP):
        v = parts[k : k + STEP].astype(kind)
        if small:
            d = (v * v).sum(1)[:, None] - 2 * (v @ b.T) + (b * b).sum(1)
        else:
            d = sum((v[:, j, None] - b[:, j]) ** 2 for j in range(v.shape[1]))
        rows = np.arange(len(v))
        at[k : k + STEP] = best = d.argmin(1)
        own[k : k + STEP] = d[rows, best]
        if len(b) > 1:
            d = d.astype(np.float64)
            d[rows, best] = np.inf
            other[k : k + STEP] = d.min(1)
    return at, own, other


class Heaps:
    """The heaps of one part position over a block: one for each entry, of (key, row)."""

    def __init__(self, sizes: np.ndarray, members: np.ndarray, keys: np.ndarray) -> None:
        ends = np.cumsum(sizes)
        self.stored = [(members[e - n : e], keys[e - n : e]) for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        self.open: dict[int, list[tuple[float, int]]] = {}

    def _heap(self, entry: int) -> list[tuple[float, int]]:
        """An entry's heap as a list, made when it is first needed; it was stored in heap order."""
        if entry not in self.open:
            members, keys = self.stored[entry]
            self.open[entry] = list(zip(keys.tolist(), members.tolist(), strict=True))
        return self.open[entry]

    def violated(self, drift: np.ndarray) -> list[int]:
        """Pop the rows whose key an entry's drift has reached."""
        out = []
        for entry, (_, keys) in enumerate(self.stored):
            reach = drift[entry] + MARGIN
            if len(keys) and keys[0] <= reach:
                heap = self._heap(entry)
                while heap and heap[0][0] <= reach:
                    out.append(heapq.heappop(heap)[1])
        return out

    def push(self, entries: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> None:
        for entry, key, row in zip(entries.tolist(), keys.tolist(), rows.tolist(), strict=True):
            heapq.heappush(self._heap(entry), (key, row))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        for entry, heap in self.open.items():
            self.stored[entry] = (np.array([r for _, r in heap], np.int32), np.array([k for k, _ in heap], np.float64))
        sizes = np.array([len(m) for m, _ in self.stored], np.int32)
        return sizes, np.concatenate([m for m, _ in self.stored]), np.concatenate([k for _, k in self.stored])


class Block:
    """Vectors (rows, parts, width of a part) with their entries and heaps."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, heaps: list[Heaps]) -> None:
        self.vectors, self.labels, self.heaps = vectors, labels, heaps

    @classmethod
    def new(cls, vectors: np.ndarray, entries: int) -> Block:
        n, parts = vectors.shape[:2]
        none = np.zeros(entries, np.int32), np.zeros(0, np.int32), np.zeros(0)
        return cls(vectors, np.full((n, parts), -1, np.int16), [Heaps(*none) for _ in range(parts)])

    @classmethod
    def load(cls, row: dict, parts: int, entries: int) -> Block:
        labels = np.frombuffer(row["labels"], np.int16).reshape(-1, parts).copy()
        vectors = np.frombuffer(row["vectors"], np.int32).reshape(len(labels), parts, -1) if len(labels) else np.zeros((0, parts, 0), np.int32)
        sizes, members, keys = (np.frombuffer(row[c], t) for c, t in (("sizes", np.int32), ("members", np.int32), ("keys", np.float64)))
        n = len(labels)
        return cls(vectors, labels, [Heaps(sizes[p * entries : (p + 1) * entries], members[p * n : (p + 1) * n], keys[p * n : (p + 1) * n]) for p in range(parts)])

    def assign(self, books: np.ndarray, drift: np.ndarray, moved: np.ndarray | None = None, counts: np.ndarray | None = None) -> int:
        """Bring entries up to date with codebooks (parts, entries, width); how many parts were compared. moved and counts take what entries gain and lose."""
        compared = 0
        for p, heaps in enumerate(self.heaps):
            fresh = np.flatnonzero(self.labels[:, p] < 0)
            rows = np.concatenate([fresh, np.array(heaps.violated(drift[p]), np.int64)])
            compared += len(rows)
            if not len(rows):
                continue
            parts = self.vectors[rows, p]
            at, own, other = nearest(parts, books[p])
            if moved is not None:
                was = self.labels[rows, p].astype(np.int64)
                new, left = at != was, (at != was) & (was >= 0)
                np.add.at(moved[p], at[new], parts[new])
                np.subtract.at(moved[p], was[left], parts[left])
                counts[p] += np.bincount(at[new], minlength=len(drift[p])) - np.bincount(was[left], minlength=len(drift[p]))
            self.labels[rows, p] = at
            heaps.push(at, np.sqrt(other) - np.sqrt(own) + drift[p][at], rows)
        return compared

    def errors(self, books: np.ndarray) -> np.ndarray:
        """Squared distances to the entries assigned, summed over parts."""
        out = np.zeros(len(self.vectors), np.int64)
        for p in range(len(books)):
            out += ((self.vectors[:, p].astype(np.int64) - books[p][self.labels[:, p]]) ** 2).sum(1)
        return out

    def stored(self) -> list[bytes]:
        kept = [h.arrays() for h in self.heaps]
        return [self.vectors.astype(np.int32).tobytes(), self.labels.tobytes(), *[np.concatenate([k[i] for k in kept]).tobytes() for i in range(3)]]


def _state(rows: list[pa.Array], stored: list[bytes], moved: list[int] | None) -> pa.RecordBatch:
    """A block as a row."""
    columns = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), *[pa.array([x], pa.binary()) for x in stored], pa.array([moved], pa.list_(pa.int64()))]
    return pa.record_batch(columns, names=["rows", *[x.split()[0] for x in STATE.split(", ")]])


class Round:
    """What a task does with its blocks: codebooks and drifts as they stand, and the gains and losses of entries so far."""

    def __init__(self, books: np.ndarray, drift: np.ndarray) -> None:
        self.books, self.drift = books, drift
        self.moved, self.counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)

    def flat(self) -> list[int]:
        return np.concatenate([self.moved.ravel(), self.counts.ravel()]).tolist()

    def held_back(self, blocks: Iterator[tuple[pa.Array, Block]]) -> Iterator[pa.RecordBatch]:
        """Blocks as rows; the last of a task carries its sums."""
        before = None
        for rows, block in blocks:
            block.assign(self.books, self.drift, self.moved, self.counts)
            if before is not None:
                yield _state(*before, None)
            before = rows, block.stored()
        if before is not None:
            yield _state(*before, self.flat())


def _packed(batches: Iterator[pa.RecordBatch], width: int, parts: int, entries: int, scale: int) -> Iterator[tuple[pa.Array, Block]]:
    """Blocks of what a task reads."""
    held: list[pa.RecordBatch] = []

    def block() -> tuple[pa.Array, Block]:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        rows, vectors = (c.chunk(0) if c.num_chunks else pa.concat_arrays(c.chunks) for c in table.columns)
        sizes, flat = np.asarray(vectors.value_lengths()).astype(np.int64), vectors.flatten().to_numpy(zero_copy_only=False)
        whole = np.zeros((len(sizes), width), np.int32)
        row = np.repeat(np.arange(len(sizes)), sizes)
        whole[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = scaled(flat, scale)
        return rows, Block.new(whole.reshape(len(sizes), parts, width // parts), entries)

    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(k, BLOCK)
            if held and sum(b.num_rows for b in held) + piece.num_rows > BLOCK:
                yield block()
            if piece.num_rows:
                held.append(piece)
    if held:
        yield block()


def _blocks(batches: Iterator[pa.RecordBatch], parts: int, entries: int) -> Iterator[tuple[pa.Array, Block]]:
    for batch in batches:
        for k, row in enumerate(batch.select(batch.schema.names[1:]).to_pylist()):
            yield batch.column(0)[k].values, Block.load(row, parts, entries)


def compressed(df: DataFrame, id_col: str, vector_col: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """df's usable rows without their vector, with `code` (two hexadecimal digits a part) and `error`, and the codebooks (parts, entries, width)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two digits for a part, so there are 256 entries at most")
    others = [c for c in df.columns if c != vector_col]
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.filter(usable(vector)).select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("rows"), vector.alias("vector"))
    width = -(-(rows.agg(F.max(F.size("vector"))).first()[0] or 0) // parts) * parts
    first = rows.orderBy(F.col(f"rows.`{id_col}`").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    begin = np.zeros((len(first), width), np.int32)
    for k, (v,) in enumerate(first):
        begin[k, : len(v)] = scaled(np.array(v, np.float64), scale)
    books = begin.reshape(len(first), parts, width // parts).transpose(1, 0, 2).astype(np.int64)
    drift = np.zeros(books.shape[:2])
    sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
    n, kind, state = len(first), f"rows array<{rows.schema['rows'].dataType.simpleString()}>, {STATE}", None

    for _ in range(rounds if n else 0):
        round_ = books.copy(), drift.copy()

        def first_pass(batches: Iterator[pa.RecordBatch], now: tuple = round_) -> Iterator[pa.RecordBatch]:
            return Round(*now).held_back(_packed(batches, width, parts, n, scale))

        def next_pass(batches: Iterator[pa.RecordBatch], now: tuple = round_) -> Iterator[pa.RecordBatch]:
            return Round(*now).held_back(_blocks(batches, parts, n))

        before, state = state, staged(map_arrow(rows, first_pass, kind) if state is None else map_arrow(state, next_pass, kind), "blocks")
        if before is not None:
            discard(before)
        gained = state.filter("moved IS NOT NULL").select(F.posexplode("moved").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x")).collect()  # as many as the codebooks have numbers
        flat = np.zeros(sums.size + counts.size, np.int64)
        flat[[r.pos for r in gained]] = [r.x for r in gained]
        sums += flat[: sums.size].reshape(sums.shape)
        counts += flat[sums.size :].reshape(counts.shape)
        new = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
        drift += _drifts(books, new)
        books = new
    if state is None:
        empty = rows.limit(0).select("rows.*").drop("code", "error")
        return empty.select("*", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, block in _blocks(batches, parts, n):
            block.assign(books, drift)
            digits = block.labels.astype(np.uint8).tobytes().hex()
            codes = [digits[k : k + 2 * parts] for k in range(0, len(digits), 2 * parts)]
            yield pa.record_batch([kept, pa.array(codes, pa.string()), pa.array(block.errors(books))], names=["rows", "code", "error"])

    made = map_arrow(state, last_pass, f"rows {rows.schema['rows'].dataType.simpleString()}, code string, error long")
    out = staged(made.select(*[F.col(f"rows.`{c}`").alias(c) for c in others if c.lower() not in ("code", "error")], "code", "error"), "codes")
    discard(state)
    return out, books


def _drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How much the slack of an entry's parts can have shrunk: by its own move, and the largest of another's."""
    move = np.sqrt(((new - old).astype(np.float64) ** 2).sum(2))
    top = np.sort(move, axis=1)[:, ::-1]
    second = top[:, 1:2] if move.shape[1] > 1 else np.zeros((len(move), 1))
    others = np.where(move == top[:, :1], np.where((move == top[:, :1]).sum(1, keepdims=True) > 1, top[:, :1], second), top[:, :1])
    return move + others


def digest(books: np.ndarray) -> str:
    """The SHA-256 of all components of codebooks in order, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def label_errors(rows: DataFrame, label_col: str) -> DataFrame:
    """rows with `label_error`, the sum of errors over equal labels, nulls together: sums by label are joined, a row for each."""
    sums = rows.groupBy(F.col(label_col).alias("__label")).agg(F.sum("error").alias("label_error"))
    return rows.drop("label_error").join(sums, F.col(label_col).eqNullSafe(F.col("__label")), "left").drop("__label")

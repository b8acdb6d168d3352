"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class in context, times that of its subclass in the class and context, times that of
the token in its cell, as class and subclass together are called. Classes are the most frequent tokens, one each, and groups
of the others by their last letters; subclasses go by the letters before those. Class and subclass have a softmax each over
hashed features of the context: the token before, the two before (n-gram), the second before alone, and the latest of the
most frequent tokens (skips). Their weights are trained by distributed gradient updates: every training text takes part in
one of ROUNDS steps, tasks sum gradients over sparse numpy batches, Spark adds them up, and the step is scaled by how often
a feature occurred. Each text is scored before it is learned from, so a step's gain is known from texts that are new to the
model; a step that made it worse is taken back by half. Inside a cell, tokens have discounted relative frequencies over the
whole training corpus; what the discount leaves is shared evenly by the unseen tokens of the cell, whose number is estimated
from the tokens seen once and twice.

Counts of the HEAD most frequent tokens go to all tasks, a table of fixed size; rarer tokens are looked up by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, map_arrow, mix, slices, span_hash, staged, utf8, words

HEAD = 1 << 18
#: Classes, those of one token among them, and subclasses of each other class.
CLASSES, SINGLE, SUBS = 32, 16, 16
CELLS = CLASSES * SUBS
#: Rows of the weight tables: of features for classes, and of features for the subclasses of a pair of classes.
BUCKETS, SUB_BUCKETS = 1 << 14, 1 << 10
#: How many of the most frequent tokens may be the latest frequent one.
FREQUENT = 64
ROUNDS = 4
RATE, RIDGE, STEP = 0.5, 20.0, 2.5
DISCOUNT = 0.5
END = np.uint64(0x9D39247E33776D41)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_TILE = 50_000
_SUMS = [f"g{k}" for k in range(CLASSES)]


@dataclass
class Tokens:
    """The tokens of a batch of texts, each text's end among them."""

    hash: np.ndarray
    ending: np.ndarray  # the cell of the last letters
    offsets: np.ndarray  # of texts among tokens


def tokens(column: pa.Array) -> Tokens:
    buf, offsets = utf8(column)
    low = buf.copy()
    low[(low >= 65) & (low <= 90)] += 32
    start, length, count = words(low, offsets)
    bare = length - (np.isin(low[start + length - 1], (44, 46)) & (length > 1)) if len(start) else length
    last = low[start + bare - 1].astype(np.int64) if len(start) else np.zeros(0, np.int64)
    second = np.where(bare > 1, low[start + np.maximum(bare, 2) - 2], 0).astype(np.int64) if len(start) else last
    third = np.where(bare > 2, low[start + np.maximum(bare, 3) - 3], 0).astype(np.int64) if len(start) else last
    fourth = np.where(bare > 3, low[start + np.maximum(bare, 4) - 4], 0).astype(np.int64) if len(start) else last
    ending = (SINGLE + (last * 131 + second * 31) % (CLASSES - SINGLE)) * SUBS + (third * 131 + fourth * 31 + second) % 251 % SUBS
    ends = np.cumsum(count + 1) - 1
    n = len(start) + len(count)
    place = np.arange(len(start)) + np.repeat(np.arange(len(count)), count)
    full = lambda x, v, kind: _spread(x, place, n, v, kind)
    return Tokens(full(span_hash(low, start, length), END, np.uint64), full(ending, SINGLE * SUBS, np.int64), np.append(0, ends + 1))


def _spread(x: np.ndarray, place: np.ndarray, n: int, fill: int, kind: type) -> np.ndarray:
    out = np.full(n, fill, kind)
    out[place] = x
    return out


@dataclass
class Head:
    """Counts of the most frequent tokens, by hash; the first SINGLE of them have classes of their own."""

    hash: np.ndarray
    count: np.ndarray
    frequent: np.ndarray  # most frequent first

    def look(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """The count of each token, 0 if it is not among them, and its cell."""
        at = np.minimum(np.searchsorted(self.hash, t.hash), max(len(self.hash) - 1, 0))
        count = np.where(self.hash[at] == t.hash, self.count[at], 0) if len(self.hash) else np.zeros(len(t.hash), np.int64)
        return count, self.cells(t)[0]

    def cells(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each token, and its rank among the frequent ones, -1 if it is none."""
        rank = np.full(len(t.hash), -1, np.int64)
        if len(self.frequent):
            order = np.argsort(self.frequent)
            at = np.minimum(np.searchsorted(self.frequent[order], t.hash), len(order) - 1)
            rank = np.where(self.frequent[order][at] == t.hash, order[at], -1)
        return np.where((rank >= 0) & (rank < SINGLE), rank * SUBS, t.ending), rank


def contexts(t: Tokens, rank: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Buckets of the features of each token's context, for classes and for subclasses."""
    one = np.roll(t.hash, 1)
    two = np.roll(t.hash, 2)
    first = t.offsets[:-1]
    one[first] = END
    two[first] = END
    second = first[np.diff(t.offsets) > 1] + 1
    two[second] = END
    # The latest frequent token before each, in the same text.
    place = np.maximum.accumulate(np.where(rank >= 0, np.arange(len(rank)), -1))
    before = np.append(-1, place[:-1])
    begin = np.repeat(first, np.diff(t.offsets))
    latest = np.where(before >= begin, rank[before], -1)
    recent = (latest + 2).astype(np.uint64) * _MULT
    shift = np.uint64(50)
    features = [(x >> shift).astype(np.uint16) for x in (mix(one), mix(one * _MULT + mix(two)), mix(two + _MULT), mix(recent))]
    return features, [(x >> np.uint64(54)).astype(np.uint16) for x in (mix(one + np.uint64(7)), mix(recent + np.uint64(7)))]


def _softmax(prior: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    logit = prior + parts[0]
    for p in parts[1:]:
        logit += p
    logit -= logit.max(axis=1, keepdims=True)
    np.exp(logit, out=logit)
    logit /= logit.sum(axis=1, keepdims=True)
    return logit


def _train_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts to learn from, with the step they take part in."""
    trains = ~F.coalesce(crc_mod(id_col, 5) == 1, F.lit(False))
    return df.filter(trains).select(F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(ROUNDS)).alias("round"))


def vocabulary(rows: DataFrame) -> DataFrame:
    """(h, ending, c): how often each token occurs in the texts, ends included; staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, e, c = (np.concatenate(x) for x in zip(*held, strict=True))
            u, first, which = np.unique(h, return_index=True, return_inverse=True)
            return u, e[first], np.bincount(which, weights=c).astype(np.int64)

        def out(x: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(x[0]), 200_000):
                part = [a[i : i + 200_000] for a in x]
                yield pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1].astype(np.int32)), pa.array(part[2])], ["h", "ending", "c"])

        for batch in slices(batches, "text"):
            t = tokens(batch.column(0))
            u, first, c = np.unique(t.hash, return_index=True, return_counts=True)
            held.append((u, t.ending[first], c))
            if sum(len(x[0]) for x in held) > 2_000_000:
                held = [merged()]
                if len(held[0][0]) > 1_000_000:
                    yield from out(held.pop())
        if held:
            yield from out(merged())

    parts = map_arrow(rows.select("text"), run, "h long, ending int, c long")
    return staged(parts.groupBy("h").agg(F.first("ending").alias("ending"), F.sum("c").alias("c")), "vocabulary")


@dataclass
class Model:
    head: Head
    prior: np.ndarray  # log of each class's share
    sub_prior: np.ndarray  # log of each subclass's share of its class
    mass: np.ndarray  # tokens of each cell
    unseen: np.ndarray  # log10 of an unseen token's part of its cell
    discount: np.ndarray
    weights: np.ndarray  # by feature and class
    sub_weights: np.ndarray  # by feature, class and subclass
    tokens: int
    distinct: int
    progress: list[float]  # log10 a token of class and subclass on the texts of each step, before they are learned from

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def inside(self, count: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """log10 of a seen token's part of its cell."""
        return np.log10(np.maximum(count - self.discount[cell], 1e-9) / np.maximum(self.mass[cell], 1))

    def chances(self, cell: np.ndarray, features: list[np.ndarray], subs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chances of all classes, of all subclasses of the class (for tokens that are none of their own), and where those are."""
        kind = cell // SUBS
        p = _softmax(self.prior, [self.weights[f] for f in features])
        many = np.flatnonzero(kind >= SINGLE)
        q = _softmax(self.sub_prior[kind[many]], [self.sub_weights[f[many], kind[many]] for f in subs])
        return p, q, many

    def chance(self, cell: np.ndarray, features: list[np.ndarray], subs: list[np.ndarray]) -> np.ndarray:
        """log10 of the chance of each token's cell in its context."""
        p, q, many = self.chances(cell, features, subs)
        out = np.log10(np.maximum(p[np.arange(len(p)), cell // SUBS], 1e-30))
        out[many] += np.log10(np.maximum(q[np.arange(len(q)), cell[many] % SUBS], 1e-30))
        return out


def _add_by(keys: np.ndarray, rows: np.ndarray, total: np.ndarray, seen: np.ndarray) -> None:
    """Add rows to those of total that keys name, and count them."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    cuts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, np.int64)
    if len(cuts):
        total[ordered[cuts]] += np.add.reduceat(rows[order], cuts, axis=0)
        seen[ordered[cuts]] += np.diff(np.append(cuts, len(keys)))


#: Rows of gradients: of features for classes; of features and pairs of classes for subclasses, two sets of SUBS numbers each; and one of the likelihood.
_PAIRS = CLASSES // 2
_LIKELIHOOD = BUCKETS + SUB_BUCKETS * _PAIRS


def _gradients(rows: DataFrame, model: Model) -> DataFrame:
    """Sums of the gradient over rows, by row of the weight tables, with n and n2, how often its feature and its second set occurred."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        total, seen = np.zeros((BUCKETS, CLASSES), np.float32), np.zeros(BUCKETS, np.int64)
        sub_total, sub_seen = np.zeros((SUB_BUCKETS * CLASSES, SUBS), np.float32), np.zeros(SUB_BUCKETS * CLASSES, np.int64)
        likelihood, count = 0.0, 0
        for batch in slices(batches, "text"):
            t = tokens(batch.column(0))
            cell, rank = m.head.cells(t)
            features, subs = contexts(t, rank)
            for i in range(0, len(cell), _TILE):
                own, c = [f[i : i + _TILE] for f in features], cell[i : i + _TILE]
                p, q, many = m.chances(c, own, mine := [f[i : i + _TILE] for f in subs])
                at, kind = np.arange(len(p)), c // SUBS
                likelihood += float(np.log10(np.maximum(p[at, kind], 1e-30)).sum() + np.log10(np.maximum(q[np.arange(len(q)), c[many] % SUBS], 1e-30)).sum())
                count += len(c)
                p *= -1
                p[at, kind] += 1
                q *= -1
                q[np.arange(len(q)), c[many] % SUBS] += 1
                for f in own:
                    _add_by(f, p, total, seen)
                for f in mine:
                    _add_by(f[many].astype(np.int32) * CLASSES + kind[many].astype(np.int32), q, sub_total, sub_seen)
        pairs, pair_seen = sub_total.reshape(-1, CLASSES), sub_seen.reshape(-1, 2)
        for offset, table, n in ((0, total, np.column_stack([seen, np.zeros_like(seen)])), (BUCKETS, pairs, pair_seen)):
            some = np.flatnonzero(n.any(axis=1))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(some + offset), pa.array(n[some, 0]), pa.array(n[some, 1]), *[pa.array(table[some, k].astype(np.float64)) for k in range(CLASSES)]], ["f", "n", "n2", *_SUMS])
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([_LIKELIHOOD]), pa.array([count]), pa.array([0]), pa.array([likelihood]), *[pa.array([0.0])] * (CLASSES - 1)], ["f", "n", "n2", *_SUMS])

    parts = map_arrow(rows.select("text"), run, "f long, n long, n2 long, " + ", ".join(f"{g} double" for g in _SUMS))
    return parts.groupBy("f").agg(F.sum("n").alias("n"), F.sum("n2").alias("n2"), *[F.sum(g).alias(g) for g in _SUMS])


def _most_frequent(vocab: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent tokens, HEAD at most, most frequent first.

    Counts are binned, exactly while small and by 64ths of an octave above, so that a few thousand numbers tell from
    which count on tokens fit; only those are brought together.
    """
    level = F.when(F.col("c") < 1024, F.col("c")).otherwise(1024 + F.floor(F.log2("c") * 64)).cast("long")
    bins = sorted(((r["level"], r["count"]) for r in vocab.groupBy(level.alias("level")).count().collect()), reverse=True)
    upto = np.cumsum([n for _, n in bins])
    fits = int((upto <= HEAD).sum())
    if not fits:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = vocab.filter(level >= bins[fits - 1][0]).select("h", "c").toArrow()
    h, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.lexsort((h, -c))
    return h[order], c[order]


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, of fixed size, and the vocabulary table. Learns from rows whose crc32 of the id leaves no 1 modulo 5."""
    rows = _train_rows(df, id_col, text_col)
    vocab = vocabulary(rows)
    h, c = _most_frequent(vocab)
    order = np.argsort(h)
    head = Head(h[order], c[order], h[:FREQUENT])
    single = F.coalesce(*[F.when(F.col("h") == int(x.view(np.int64)), F.lit(k * SUBS)) for k, x in enumerate(h[:SINGLE])], "ending") if len(h) else F.col("ending")
    once, twice = (F.count_if(F.col("c") == k).alias(f"f{k}") for k in (1, 2))
    table = vocab.groupBy(single.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v"), once, twice).collect()  # a row for each cell
    mass, kinds, hidden = np.zeros(CELLS), np.zeros(CELLS), np.ones(CELLS)
    for r in table:
        mass[r["k"]], kinds[r["k"]], hidden[r["k"]] = r["c"], r["v"], max(1.0, r["f1"] * (r["f1"] - 1) / (2 * (r["f2"] + 1)))
    by_class = mass.reshape(CLASSES, SUBS)
    prior = np.log((by_class.sum(1) + 0.5) / (mass.sum() + 0.5 * CLASSES)).astype(np.float32)
    sub_prior = np.log((by_class + 0.5) / (by_class.sum(1, keepdims=True) + 0.5 * SUBS)).astype(np.float32)
    discount = np.where(np.arange(CELLS) < SINGLE * SUBS, 0.0, DISCOUNT)
    left = np.where(mass > 0, np.maximum(discount * kinds, 1e-9) / np.maximum(mass, 1), 1.0)
    unseen = np.log10(left) - np.log10(np.where(mass > 0, hidden, kinds.sum() + 1))
    weights, sub_weights = np.zeros((BUCKETS, CLASSES), np.float32), np.zeros((SUB_BUCKETS, CLASSES, SUBS), np.float32)
    model = Model(head, prior, sub_prior, mass, unseen, discount, weights, sub_weights, int(mass.sum()), int(kinds.sum()), [])
    for step in range(ROUNDS):
        learn(model, _gradients(rows.filter(F.col("round") == step), model).toArrow())  # as many rows as the weight tables have, a fixed number
    return model, vocab


def learn(model: Model, gradients: pa.Table) -> None:
    """One step of a model by summed gradients. If the texts show that the step before made it worse, half of that is taken back."""
    f, n, n2 = (gradients.column(x).to_numpy() for x in ("f", "n", "n2"))
    g = np.column_stack([gradients.column(x).to_numpy() for x in _SUMS]) if len(f) else np.zeros((0, CLASSES))
    at = np.flatnonzero(f == _LIKELIHOOD)
    if not len(at):
        return
    model.progress.append(float(g[at[0], 0] / n[at[0]]))
    worse = len(model.progress) > 1 and model.progress[-1] < model.progress[-2]
    share, sub_share = np.exp(model.prior), np.exp(model.sub_prior)
    move = np.zeros_like(model.weights)
    mine = np.flatnonzero(f < BUCKETS)
    move[f[mine]] = np.clip(RATE * g[mine] / (n[mine, None] * share * (1 - share) + RIDGE), -STEP, STEP)
    sub_move = np.zeros((SUB_BUCKETS * _PAIRS, 2, SUBS), np.float32)
    mine = np.flatnonzero((f >= BUCKETS) & (f < _LIKELIHOOD))
    pair = f[mine] - BUCKETS
    spread = (sub_share * (1 - sub_share)).reshape(_PAIRS, 2, SUBS)[pair % _PAIRS]
    sub_move[pair] = np.clip(RATE * g[mine].reshape(-1, 2, SUBS) / (np.column_stack([n[mine], n2[mine]])[:, :, None] * spread + RIDGE), -STEP, STEP)
    sub_move = sub_move.reshape(SUB_BUCKETS, CLASSES, SUBS)
    if worse:  # gradients at a point that overshot are of no use
        model.weights, model.sub_weights = model.weights / 2, model.sub_weights / 2
    else:
        model.weights, model.sub_weights = model.weights + move, model.sub_weights + sub_move


def scored(df: DataFrame, model: Model, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without its text, with n_tokens, n_known, train_tokens, base_score and score (log10), which displace columns of
    those names; null counts as empty.

    An empty text is its end alone. With nothing to learn from, every token is unseen.
    """
    own = ["__row", "n_tokens", "n_known", "base_score", "score", "__rare"]
    df = df.drop(*own, "train_tokens")
    kept = [f for f in df.schema.fields if f.name != text_col]
    names = [f.name for f in kept]
    held = df.sparkSession.sparkContext.broadcast(model)
    rare_type = pa.list_(pa.struct([("h", pa.int64()), ("k", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = held.value, TaskContext.get().partitionId() << 40
        for batch in slices(batches, text_col):
            t = tokens(batch.column(batch.schema.get_field_index(text_col)))
            count, kind = m.head.look(t)
            features, subs = contexts(t, m.head.cells(t)[1])
            chance = np.empty(len(kind))
            for i in range(0, len(kind), _TILE):
                part = slice(i, i + _TILE)
                chance[part] = m.chance(kind[part], [f[part] for f in features], [f[part] for f in subs])
            known = count > 0
            base = np.where(known, m.base(count), 0.0)
            score = chance + np.where(known, m.inside(count, kind), 0.0)
            first = t.offsets[:-1]
            rare = np.flatnonzero(~known)
            per = np.searchsorted(rare, t.offsets).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(t.hash[rare].view(np.int64)), pa.array(kind[rare].astype(np.int32))], ["h", "k"])
            made = [
                pa.array(np.arange(row, row + batch.num_rows)), pa.array(np.diff(t.offsets)), pa.array(np.add.reduceat(known.astype(np.int64), first)),
                pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(score, first)), pa.ListArray.from_arrays(pa.array(per), items).cast(rare_type),
            ]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], *made], [*names, *own])

    rare_field = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("k", T.IntegerType())]))
    fields = [T.StructField(n, k) for n, k in zip(own, (T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), rare_field), strict=True)]
    head = staged(map_arrow(df, run, T.StructType([*kept, *fields])), "head-scores")
    rare = head.select("__row", F.explode("__rare").alias("r")).select("__row", "r.h", "r.k")
    # Rare tokens are rare in the corpus, so no key of this join is hot.
    found = rare.join(vocab.select("h", "c"), "h", "left")
    at = lambda x: F.element_at(F.lit([float(v) for v in x]), F.col("k") + 1)
    known = F.col("c").isNotNull()
    base = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / (model.tokens + 0.5 * (model.distinct + 1)))
    inside = F.when(known, F.log10(F.greatest(F.col("c") - at(model.discount), F.lit(1e-9)) / F.greatest(at(model.mass), F.lit(1.0)))).otherwise(at(model.unseen))
    sums = found.groupBy("__row").agg(F.count("c").alias("__known"), F.sum(base).alias("__base"), F.sum(inside).alias("__score"))
    add = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return head.drop("__rare").join(sums, "__row", "left").select(*names, "n_tokens", add("n_known", "__known"), F.lit(model.tokens).cast("long").alias("train_tokens"), add("base_score", "__base"), add("score", "__score"))

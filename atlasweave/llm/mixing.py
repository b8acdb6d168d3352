"""Mixing sources to target weights, in DataFrame operations only.

A source's documents have a random order (a hash), cut into BLOCKS equal ranges of it. Its quota counts the block draws
that reach its target: whole passes over the blocks, then parts of further passes. A part goes along the order up to the
first document that no longer fits, then along the rest of it with documents no longer than what is left, and so on; where
a pass has nothing more that fits, the next begins, up to REPEATS. So a long document does not keep its source short. A
binary tree over the output shards splits all quotas at once by the multivariate hypergeometric law, a source after another,
and the draws of a source go to the shards in turn as disjoint ranges. In its shard each copy gets a random place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: Equal ranges of a source's random order, which are what shards draw.
BLOCKS = 256
#: Output shards, a power of two.
SHARDS = 16
#: A source is taken this many times at most.
REPEATS = 3
#: Sources up to this number are broadcast; beyond it the join shuffles and splits hot sources.
FEW_SOURCES = 20_000
#: Parts of passes that a source is filled by, at most; what each leaves is less than a document that the next may take.
PARTS = 4
_PLAN = ("passes", "steps", "extra", "offsets")
_STEPS = "array<struct<pass: int, most: double, cut: bigint>>"
#: Passes in which the steps of a source take a document.
_TAKEN = "size(array_distinct(transform(filter(steps, s -> ord < s.cut and size <= s.most), s -> s.pass)))"
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Words of a text: maximal runs outside space and \\x09-\\x0D; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(_WORD)), F.lit(0)).cast("long")


def _order(id_col: str, text_col: str, seed: int) -> Column:
    """A number in [0, 2^32): the document's place in the random order."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 32)


def _log_factorial(x: str) -> str:
    """SQL for log(x!), by Stirling's series at x + 8."""
    y = f"(({x}) + 8D)"
    product = " * ".join(f"(({x}) + {k}D)" for k in range(1, 9))
    return f"(({y} + 0.5D) * ln({y}) - {y} + 0.9189385332046727D + 1D/(12D*{y}) - 1D/(360D*{y}*{y}*{y}) - ln({product}))"


def _draw(k: str, rest: str, n: str, u: str) -> str:
    """SQL for a hypergeometric draw by inversion: of n drawn from k marked and rest unmarked, how many are marked."""
    lo, hi = f"greatest(0L, {n} - ({rest}))", f"least({k}, {n})"
    lf = _log_factorial
    base = f"({lf(k)} + {lf(rest)} + {lf(n)} + {lf(f'{k} + {rest} - {n}')} - {lf(f'{k} + {rest}')})"
    chance = f"exp({base} - {lf('x')} - {lf(f'{k} - x')} - {lf(f'{n} - x')} - {lf(f'{rest} - {n} + x')})"
    step = f"named_struct('cum', a.cum + {chance}, 'at', if(a.cum + {chance} < {u}, x + 1L, a.at))"
    return f"least({hi}, aggregate(sequence({lo}, {hi}), named_struct('cum', 0D, 'at', {lo}), (a, x) -> {step}, a -> a.at))"


def _split_tree(quotas: DataFrame, seed: int, shards: int) -> DataFrame:
    """From (place, quota) to (place, offsets): where each shard's range of a source's draws begins.

    One row holds all quotas and is split log2(shards) times; so many numbers as sources, at most.
    """
    node = quotas.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "quota"))), lambda x: x["quota"]).alias("q")).select(F.lit(1).cast("long").alias("node"), F.coalesce("q", F.expr("array()").cast("array<bigint>")).alias("q"))
    u = f"((shiftrightunsigned(xxhash64({seed}L, node, size(s.out)), 11)) / 9007199254740992D)"
    sums = "aggregate(q, 0L, (a, x) -> a + x)"
    # out has what was drawn so far; left is still to be drawn, and the last source's draw is taken off it before the next.
    left = "(s.left - coalesce(try_element_at(s.out, -1), 0L))"
    fold = f"""aggregate(q, named_struct('out', cast(array() as array<bigint>), 'rest', total, 'left', half),
        (s, k) -> named_struct('out', concat(s.out, array({_draw("k", "(s.rest - k)", left, u)})), 'rest', s.rest - k, 'left', {left}), s -> s.out)"""
    for _ in range(shards.bit_length() - 1):
        node = node.withColumn("total", F.expr(sums)).withColumn("half", F.expr("total div 2"))
        node = node.withColumn("lower", F.expr(fold))
        node = node.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("lower").alias("q")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", "lower", lambda a, b: a - b).alias("q")),
        )).alias("x")).select("x.*")
    leaves = node.select("node", F.posexplode("q").alias("place0", "draws"))
    taken = leaves.groupBy((F.col("place0") + 1).cast("long").alias("place")).agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "draws"))), lambda x: x["draws"]).alias("draws"))
    begins = F.expr("transform(draws, (d, i) -> aggregate(slice(draws, 1, i), 0L, (a, x) -> a + x))")
    return taken.select("place", begins.alias("offsets"))


def plan(sizes: DataFrame, seed: int = 0, shards: int = SHARDS) -> DataFrame:
    """One row for each source: size, target, whole passes, the cut in the random order of the last pass, shard offsets.

    sizes has (source, size, place_in_order). Targets: weights 1, 2, 3 in turn by code point of the source, null last;
    none above REPEATS times its size, the excess shared again by weight: the level at which the weights' shares, each
    held under its cap, use up all words.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("place", F.row_number().over(every).cast("long")).withColumn("weight", ((F.col("place") - 1) % 3 + 1).cast("double"))
    cap = F.col("source_size") * float(REPEATS)
    ranked = ranked.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    # Sources reach their caps in order of ratio: the level after the first k are full is what is left over their weights.
    up = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    on = Window.orderBy("ratio", "place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("weight").over(on)
    ranked = ranked.withColumn("level", level).withColumn("open", F.col("level") <= F.col("ratio"))
    final = F.min(F.when(F.col("open"), F.struct("ratio", "place", "level"))).over(whole)["level"]
    ranked = ranked.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.coalesce(final, F.lit(float("inf")))))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ranked = ranked.withColumn("passes", F.least(passes, F.lit(REPEATS).cast("long")))
    ranked = ranked.withColumn("rest", F.when(F.col("passes") < REPEATS, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(0.0))
    ranked = staged(ranked.select("source", "place", "source_size", "target", "passes", "rest"), "sources")

    few = ranked.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    placed = _beside(sizes, ranked.select("source", "place")).drop("source").filter("size > 0")
    least = placed.groupBy("place").agg(F.min("size").alias("least"))
    state = ranked.join(least, "place", "left").select("place", "passes", "rest", "least", F.lit(0).alias("pass"), F.expr(f"cast(array() as {_STEPS})").alias("steps"))
    state = staged(state, "filling")
    for part in range(PARTS):
        live = state.filter(F.col("rest") >= F.col("least")).filter(F.col("passes") + F.col("pass") < REPEATS)
        if part and live.isEmpty():
            break
        free = _with(placed, live.select("place", "rest", "pass", "steps"), few).filter(F.expr("size <= rest and not exists(steps, s -> s.pass = pass and ord < s.cut and size <= s.most)"))
        found = _fill(free.select("place", "size", "ord"), live.select("place", "rest"), few).select("place", F.col("cut"), F.col("rest").alias("now"))
        step = F.array(F.struct(F.col("pass"), F.col("rest").alias("most"), F.col("cut")))
        # A pass whose order ended has nothing more that fits.
        over = F.col("cut") >= F.lit(1 << 32)
        filled = state.join(found, "place", "left")
        state = staged(filled.select("place", "passes", F.coalesce("now", "rest").alias("rest"), "least", F.when(over, F.col("pass") + 1).otherwise(F.col("pass")).alias("pass"), F.when(F.col("cut").isNotNull(), F.concat("steps", step)).otherwise(F.col("steps")).alias("steps")), "filling")
    # One more document, the nearest in size to what is left, closes the gap.
    gap = F.abs(F.col("size") - F.col("rest"))
    spare = _with(placed, state.select("place", "passes", "rest", "steps"), few).filter(F.expr(f"passes + {_TAKEN} < {REPEATS}")).filter(gap < F.col("rest"))
    extra = spare.groupBy("place").agg(F.min(F.struct(gap.alias("gap"), "ord"))["ord"].alias("extra"))
    ranked = ranked.drop("rest", "passes").join(state.select("place", "passes", "steps"), "place").join(extra, "place", "left")
    final = "aggregate(steps, named_struct('pass', -1, 'cut', 0L), (a, s) -> named_struct('pass', s.pass, 'cut', if(s.pass = a.pass, greatest(a.cut, s.cut), s.cut)))"
    blocks = F.expr(f"({final}).pass * {BLOCKS}L + least({BLOCKS}L, cast(ceil(({final}).cut / {float(1 << 24)}D) as bigint))")
    ranked = staged(ranked.withColumn("quota", F.col("passes") * BLOCKS + F.when(F.size("steps") > 0, blocks).otherwise(0)), "quotas")
    offsets = _split_tree(ranked.select("place", "quota"), seed, shards)
    return staged(ranked.join(offsets, "place"), "mix-plan")


def _with(rows: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    """rows with the columns of their source's place."""
    return rows.join(F.broadcast(table) if few else table, "place")


def _fill(rows: DataFrame, rest: DataFrame, few: bool) -> DataFrame:
    """(place, cut, rest): how far in the order a source's rows fit into its rest, and what is left then.

    rows has (place, size, ord). The cut is found by 12 bits of the order, from sums over 4,096 parts of it, then by the other
    20 among the rows of one part.
    """
    rest = rest.withColumn("base", F.lit(0).cast("long"))
    top = 32
    done = None
    run = Window.partitionBy("place").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for shift in (20, 0):
        width = F.lit(1 << top).cast("long")
        top = shift
        inside = _with(rows, rest.select("place", "base"), few).filter((F.col("ord") >= F.col("base")) & (F.col("ord") < F.col("base") + width))
        parts = inside.groupBy("place", F.shiftright(F.col("ord") - F.col("base"), shift).alias("part")).agg(F.sum("size").alias("words"))
        filled = parts.join(rest, "place").withColumn("upto", F.sum("words").over(run))
        fits = F.sum(F.when(F.col("upto") <= F.col("rest"), F.col("words"))).alias("used")
        found = filled.groupBy("place").agg(fits, F.min(F.when(F.col("upto") > F.col("rest"), F.col("part"))).alias("at"))
        begin = F.when(F.col("at").isNull(), width).otherwise(F.col("at") * F.lit(1 << shift).cast("long"))
        step = staged(rest.join(found, "place", "left").select("place", (F.col("rest") - F.coalesce("used", F.lit(0))).alias("rest"), F.col("at").isNull().alias("all"), (F.col("base") + begin).alias("base")), "cut")
        ends = step if not shift else step.filter("all")  # all that there is fits
        ends = ends.select("place", F.col("base").alias("cut"), "rest")
        done = ends if done is None else done.unionByName(ends)
        rest = step.filter(~F.col("all")).select("place", "rest", "base")
    return done


def _beside(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """rows with the columns of their source: broadcast while sources are few, else a shuffled join that splits hot sources."""
    other = per_source.withColumnRenamed("source", "__source")
    few = per_source.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    return rows.join(F.broadcast(other) if few else other, rows["source"].eqNullSafe(other["__source"])).drop("__source")


def measured(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """(id, source, size, ord) of each row, staged: the only reading of the texts that planning needs."""
    return staged(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), _order(id_col, text_col, seed).alias("ord")), "sizes")


def _draws(seed: int) -> tuple[Column, Column]:
    """The copies of a row and their number: an array of (pass, shard, place in the shard); pass p of block b is draw p * BLOCKS + b."""
    copies = F.col("passes") + F.expr(_TAKEN) + F.coalesce((F.col("ord") == F.col("extra")) & (F.col("passes") + F.expr(_TAKEN) < REPEATS), F.lit(False)).cast("long")
    return F.expr(
        f"transform(if(size > 0 and __copies > 0, sequence(0L, __copies - 1), cast(array() as array<bigint>)), p -> named_struct('pass', p, "
        f"'shard', size(filter(offsets, o -> o <= p * {BLOCKS} + shiftright(ord, 24))) - 1, 'shuffle', xxhash64({seed}L, ord, p)))"
    ), copies


def mix_sizes(sizes: DataFrame, seed: int = 0, shards: int = SHARDS) -> DataFrame:
    """Rows of measured() with source_size, target and draws, the array of the copies that the mix takes."""
    draws, copies = _draws(seed)
    found = _beside(sizes, plan(sizes, seed, shards).select("source", "source_size", "target", *_PLAN))
    return found.withColumn("__copies", copies).withColumn("draws", draws).drop("__copies", *_PLAN)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, shards: int = SHARDS) -> DataFrame:
    """The mix itself: each row of df as many times as it is taken, dealt by shard and shuffled inside it; columns of df.

    Rows without words are in no mix. Null ids, texts and sources take part (a null source is one source, the last).
    The order depends on id, text and seed alone, so reruns agree; rows alike in both are taken together.
    """
    sizes = measured(df, id_col, text_col, source_col, seed)
    table = plan(sizes, seed, shards).select("source", "source_size", "target", *_PLAN)
    rows = df.select(F.struct("*").alias("row"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), _order(id_col, text_col, seed).alias("ord"))
    draws, copies = _draws(seed)
    taken = _beside(rows, table).withColumn("__copies", copies).select("row", F.explode(draws).alias("draw"))
    dealt = taken.repartition("draw.shard", F.pmod(F.col("draw.shuffle"), F.lit(64))).sortWithinPartitions("draw.shard", "draw.shuffle")
    return dealt.select("row.*")

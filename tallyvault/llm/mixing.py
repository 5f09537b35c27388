"""Mixing sources to target weights.

Method: temperature mixing.  With p the token shares of the sources, the weights are
p ** t / sum(p ** t).  t = 1 leaves the shares as they are and t = 0 makes them equal.
Bisection finds the largest t whose weights reach the target entropy (a share of the
greatest possible), or, if that repeats some source more often than `most_repeats`, the
smallest t that does not.  The budget is then dealt to the sources by weight.  A source's
documents stand in a random order; its budget takes whole rounds of that order and of a
last round the documents up to the first that does not fit or, with `fill`, every
document in turn that still fits.  The copies are laid out in blocks in which
every source has its share, and within a block at random.

DataFrame and SQL functions only.  Rows that share source, id and token count are alike to
the mix and are one row with a count until copies are dealt, so an id that many rows have,
or none, makes no slice large.  Running sums are taken in two steps, over the slices of a
source's order and within a slice, so no task holds more than a slice of a source.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvault.llm.common import settle

ENTROPY = 0.95
MOST_REPEATS = 4.0
BLOCK_TOKENS = 1 << 20
STEPS = 50
SEED = 7
#: Rows of a slice, about; a slice is a range of the first 20 bits of the order's hash.
SLICE_ROWS = 250
#: Tables of more rows (of sources, or of documents' copies; about 60 bytes each) are joined by shuffling, others broadcast.
BROADCAST_ROWS = 250_000
#: Sources whose counts come to the driver for the bisection; of more, each step is an aggregate, with the same result.
COLLECTED = 10_000
#: Alike rows that one task deals copies of.
CHUNK = 10_000
KEYS = ("__tv_key", "__tv_source", "__tv_tokens")
Sums = Callable[[float], tuple[float, float, float]]


def solved(sums: Sums, sources: int, total: int, budget: int, entropy: float, most_repeats: float) -> float:
    """The exponent t in [0, 1], by bisection; 1 for fewer than two sources.

    `sums` gives, over the shares p: the sum of p**t, that of p**t * ln(p), and the greatest p**(t - 1).
    """
    if sources < 2:
        return 1.0

    def spread(t: float) -> float:
        z, logs, _ = sums(t)
        return math.log(z) - t * logs / z

    def repeats(t: float) -> float:
        z, _, most = sums(t)
        return most * budget / (total * z)

    def bisected(low_side: Callable[[float], bool]) -> tuple[float, float]:
        lo, hi = 0.0, 1.0
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if low_side(mid) else (lo, mid)
        return lo, hi

    goal = entropy * math.log(sources)
    t = 1.0 if spread(1.0) >= goal else bisected(lambda m: spread(m) >= goal)[0]
    if repeats(t) <= most_repeats:
        return t
    return 1.0 if repeats(1.0) > most_repeats else max(t, bisected(lambda m: repeats(m) > most_repeats)[1])


def exponent(tokens: list[int], budget: int, entropy: float = ENTROPY, most_repeats: float = MOST_REPEATS) -> float:
    """The exponent for the sources' token counts."""
    total = sum(tokens)
    p = [x / total for x in tokens]

    def sums(t: float) -> tuple[float, float, float]:
        powers = [x**t for x in p]
        return sum(powers), sum(w * math.log(x) for w, x in zip(powers, p, strict=True)), max(x ** (t - 1) for x in p)

    return solved(sums, len(p), total, budget, entropy, most_repeats)


def weights(tokens: DataFrame, budget: int | None = None, entropy: float = ENTROPY, most_repeats: float = MOST_REPEATS) -> DataFrame:
    """source, tokens, weight and goal (tokens of the mix) from source and tokens, one row a source.

    The budget is all tokens if none is given.  The counts of up to COLLECTED sources come
    to the driver for the bisection; those of more stay where they are.
    """
    n, total = tokens.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    budget = budget or total
    p = F.col("tokens") / F.lit(float(max(total, 1)))
    if n <= COLLECTED:
        counts = sorted(r["tokens"] for r in tokens.select("tokens").collect())
        t = exponent(counts, budget, entropy, most_repeats)
        z = sum((x / total) ** t for x in counts)
    else:

        def sums(t: float) -> tuple[float, float, float]:
            power = F.pow(p, F.lit(t))
            return tuple(tokens.agg(F.sum(power), F.sum(power * F.log(p)), F.max(F.pow(p, F.lit(t - 1)))).first())

        t = solved(sums, n, total, budget, entropy, most_repeats)
        z = sums(t)[0]
    weight = F.pow(p, F.lit(t)) / F.lit(z or 1.0)
    return tokens.withColumn("weight", weight).withColumn("goal", F.floor(F.col("weight") * F.lit(float(budget)) + 1e-6).cast("long"))


def counted(docs: DataFrame) -> DataFrame:
    """`docs` with __tv_source (null: empty name) and __tv_tokens: words between white space, at least one."""
    words = F.size(F.split(F.trim(F.coalesce(F.col("text").cast("string"), F.lit(""))), "[ \\n\\t\\r]+"))
    return docs.withColumn("__tv_source", F.coalesce(F.col("source").cast("string"), F.lit(""))).withColumn("__tv_tokens", words.cast("long"))


def key_of(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("")).alias("__tv_key")


def alike(docs: DataFrame) -> DataFrame:
    """A row for each source, key (doc_id as text) and token count, with the number of rows that have them as _m."""
    return settle(counted(docs).select(key_of(), "__tv_source", "__tv_tokens").groupBy(*KEYS).agg(F.count("*").alias("_m")))


def along(rows: DataFrame) -> DataFrame:
    """`rows` (each of _m alike documents) with _before, the running sum of tokens ahead of them in each source's order."""
    mass = F.col("__tv_tokens") * F.col("_m")
    sums = rows.groupBy("__tv_source", "_slice").agg(F.sum(mass).alias("_sum"))
    ahead = sums.withColumn("_ahead", F.sum("_sum").over(Window.partitionBy("__tv_source").orderBy("_slice")) - F.col("_sum")).select("__tv_source", "_slice", "_ahead")
    within = Window.partitionBy("__tv_source", "_slice").orderBy("_order", "__tv_key", "__tv_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_in", F.sum(mass).over(within) - mass).join(ahead, ["__tv_source", "_slice"]).withColumn("_before", F.col("_ahead") + F.col("_in")).drop("_ahead", "_in")


def fits(room: Column) -> Column:
    """How many of a row's alike documents fit into `room` tokens, after those before them."""
    return F.greatest(F.lit(0), F.least(F.col("_m"), F.floor((room - F.col("_before")) / F.col("__tv_tokens")))).cast("long")


def fitting(rows: DataFrame, small: bool) -> DataFrame:
    """What the last round takes: in a source's order every document that fits in what is left of _rest; _m of them after _before.

    A pass takes the documents up to the first that does not fit, and leaves to the next
    those behind it that still may; so it ends when none fits.
    """
    todo, taken = rows.drop("_before").filter("__tv_tokens <= _rest").withColumn("_gap", F.col("_rest")), []
    while True:
        todo = settle(along(todo).withColumn("_fit", fits(F.col("_gap"))))
        got = todo.filter("_fit > 0")
        taken.append(got.withColumn("_m", F.col("_fit")).withColumn("_before", F.col("_rest") - F.col("_gap") + F.col("_before")).drop("_gap", "_fit"))
        took = got.groupBy("__tv_source").agg(F.max(F.col("_before") + F.col("_fit") * F.col("__tv_tokens")).alias("_took"))
        # of a row that is taken in part the rest does not fit, and goes with the others that do not
        left = todo.withColumn("_m", F.col("_m") - F.col("_fit")).filter("_m > 0").drop("_before", "_fit").join(F.broadcast(took) if small else took, "__tv_source")
        todo = left.withColumn("_gap", F.col("_gap") - F.col("_took")).drop("_took").filter("__tv_tokens <= _gap")
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, taken)


def dealt(rows: DataFrame) -> DataFrame:
    """A row for each of the _m alike documents, _j from 1; a row of very many is first split and spread."""
    if (rows.agg(F.max("_m")).first()[0] or 0) > CHUNK:
        rows = rows.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_m - 1) div {CHUNK}")))).repartition("__tv_key", "__tv_source", "__tv_tokens", "_chunk")
        first, last = F.col("_chunk") * CHUNK + 1, F.least(F.col("_m"), (F.col("_chunk") + 1) * CHUNK)
        return rows.withColumn("_j", F.explode(F.sequence(first, last))).drop("_chunk")
    return rows.withColumn("_j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m"))))


def placed(items: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, fill: bool = False) -> DataFrame:
    """The copies of the mix: key, source and tokens of `items` (see `alike`), with _j, copy, block, at (0 to 1 in its source's budget) and weight."""
    n = items.count()
    bits = max(0, min(20, (max(1, n // SLICE_ROWS)).bit_length()))
    order = F.md5(F.concat_ws("/", F.lit(seed), "__tv_key"))
    slices = items.withColumn("_order", order).withColumn("_slice", F.shiftright(F.conv(F.substring("_order", 1, 5), 16, 10).cast("int"), 20 - bits))
    sources = targets.select(F.col("source").alias("__tv_source"), F.col("tokens").alias("_all"), "goal", "weight")
    small = sources.count() <= BROADCAST_ROWS
    known = along(slices).join(F.broadcast(sources) if small else sources, "__tv_source").withColumn("_rounds", F.expr("goal div _all")).withColumn("_rest", F.expr("goal % _all"))
    known = settle(known)
    last = fitting(known, small) if fill else known.withColumn("_m", fits(F.col("_rest"))).filter("_m > 0")
    whole = dealt(known.filter("_rounds > 0")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rounds"))))
    each = whole.unionByName(dealt(last).withColumn("copy", F.col("_rounds") + 1))
    start = F.col("_before") + (F.col("_j") - 1) * F.col("__tv_tokens")
    each = each.withColumn("at", ((F.col("copy") - 1) * F.col("_all") + start) / F.col("goal"))
    blocks = F.greatest(F.lit(1), F.ceil(F.lit(targets.agg(F.sum("goal")).first()[0] or 0) / block_tokens))
    return each.withColumn("block", F.floor(F.col("at") * blocks).cast("long")).select(*KEYS, "_j", "copy", "block", "at", "weight")


def shuffled(seed: int, copy: str = "copy") -> list[Column]:
    """The order of copies within a block."""
    return [F.md5(F.concat_ws("/", F.lit(seed), "__tv_key", copy)), F.col("__tv_key"), F.col(copy), F.col("__tv_source"), F.col("__tv_tokens")]


def targets_of(items: DataFrame, budget: int | None, entropy: float, most_repeats: float) -> DataFrame:
    return settle(weights(items.groupBy(F.col("__tv_source").alias("source")).agg(F.sum(F.col("__tv_tokens") * F.col("_m")).alias("tokens")), budget, entropy, most_repeats))


def mixed(docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, most_repeats: float = MOST_REPEATS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, fill: bool = False) -> DataFrame:
    """doc_id, source, copy, block, position (in its block, from 0), tokens and weight of each copy of a document in the mix.

    A null source is one source with an empty name.  Tokens are words between white space;
    null and empty texts count as one.  Rows are told apart by doc_id, source and token
    count: rows that share them stand side by side in the order, and each is in the mix by
    itself.  Columns other than doc_id, text and source are ignored.  An empty table gives an
    empty mix.  With `fill`, which the SQL does not have, the last round leaves out only
    documents that do not fit, and a column realised has each source's share of the mix's
    tokens beside its weight.
    """
    items = alike(docs)
    copies = placed(items, targets_of(items, budget, entropy, most_repeats), block_tokens, seed, fill)
    spot = F.row_number().over(Window.partitionBy("block").orderBy(*shuffled(seed))) - 1
    out = copies.select(F.col("__tv_key").try_cast("long").alias("doc_id"), F.col("__tv_source").alias("source"), F.col("copy").cast("int").alias("copy"), "block", spot.cast("int").alias("position"), F.col("__tv_tokens").alias("tokens"), F.round("weight", 6).alias("weight"))
    if not fill:
        return out
    shares = settle(copies.groupBy(F.col("__tv_source").alias("source")).agg(F.sum("__tv_tokens").alias("_mixed")))
    total = shares.agg(F.sum("_mixed")).first()[0] or 1
    shares = shares.select("source", F.round(F.col("_mixed") / F.lit(float(total)), 6).alias("realised"))
    return out.join(F.broadcast(shares) if shares.count() <= BROADCAST_ROWS else shares, "source").select(*out.columns, "realised")


def numbered(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`docs` with its key, source and tokens, and __tv_j: the number of a row among those alike.

    Rows without their like have 1 and are not moved.  Others are numbered in two steps, over
    partitions and within one, so that no task holds more than a partition's part of them.
    """
    keyed = counted(docs).withColumn("__tv_key", key_of())
    again = items.filter("_m > 1").select(*KEYS)
    some, first = again.count(), F.lit(1).cast("long")
    if not some:
        return keyed.withColumn("__tv_j", first)
    many = F.broadcast(again) if some <= BROADCAST_ROWS else again
    rows = settle(keyed.join(many, list(KEYS), "left_semi").withColumn("__tv_row", F.monotonically_increasing_id()).withColumn("__tv_part", F.shiftright("__tv_row", 33)))
    counts = rows.groupBy(*KEYS, "__tv_part").agg(F.count("*").alias("__tv_n"))
    ahead = counts.withColumn("__tv_ahead", F.sum("__tv_n").over(Window.partitionBy(*KEYS).orderBy("__tv_part")) - F.col("__tv_n")).drop("__tv_n")
    own = F.row_number().over(Window.partitionBy(*KEYS, "__tv_part").orderBy("__tv_row"))
    told = rows.withColumn("__tv_own", own).join(ahead, [*KEYS, "__tv_part"]).withColumn("__tv_j", (F.col("__tv_ahead") + F.col("__tv_own")).cast("long"))
    return keyed.join(many, list(KEYS), "left_anti").withColumn("__tv_j", first).unionByName(told.drop("__tv_row", "__tv_part", "__tv_ahead", "__tv_own"))


def resampled(docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, most_repeats: float = MOST_REPEATS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """`docs` as the mix has them, its last rounds filled: a row for each copy, with all its columns, within the budget.

    Blocks are kept together and, within a partition, in order, each in its own random order,
    so files that are written as they come hold whole block permutations.  Nulls, ties and
    repeated rows are as in `mixed`; an empty table gives an empty one.
    """
    items = alike(docs)
    copies = settle(placed(items, targets_of(items, budget, entropy, most_repeats), block_tokens, seed, fill=True).select(*KEYS, F.col("_j").alias("__tv_j"), F.col("copy").alias("__tv_copy"), F.col("block").alias("__tv_block")))
    few = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
    out = numbered(docs, items).join(few, [*KEYS, "__tv_j"])
    return out.repartition("__tv_block").sortWithinPartitions("__tv_block", *shuffled(seed, "__tv_copy")).select(*docs.columns)

"""Packing documents into sequences of at most `capacity` tokens.

Method: a grouping genetic algorithm.  Documents of equal length are interchangeable,
so a chromosome is a list of bins of lengths.  Crossover injects the well-filled bins
of one parent whole into another, drops the bins that would use a document twice, and
best-fits the documents so displaced.  Pieces are dealt by hash into shards of bounded
size; `islands` populations evolve each shard as separate rows, hand their elite to
their neighbour in a ring after each round, and the best island's packing is taken.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyvault.llm.common import settle
from tallyvault.llm.tokens import VOCABULARY, encoder

CAPACITY = 1024
END_ID = 2
SHARD = 32_768
ISLANDS = 2
ROUNDS = 2
POPULATION = 4
GENERATIONS = 3


class Fitter:
    """Best fit over the counts of what is left, smallest slack first."""

    def __init__(self, lengths: Iterable[int], capacity: int):
        self.capacity, self.left, self.mask, self.mirror = capacity, Counter(), 0, 0
        for x in lengths:
            self.add(x)

    def add(self, x: int) -> None:
        if not self.left[x]:
            self.mask |= 1 << x
            self.mirror |= 1 << (self.capacity - x)
        self.left[x] += 1

    def take(self, x: int) -> int:
        self.left[x] -= 1
        if not self.left[x]:
            self.mask &= ~(1 << x)
            self.mirror &= ~(1 << (self.capacity - x))
        return x

    def takes(self, wanted: list[int]) -> bool:
        """Take a whole bin, if all of it is left."""
        need = Counter(wanted)
        if any(self.left[x] < n for x, n in need.items()):
            return False
        for x in wanted:
            self.take(x)
        return True

    def fill(self, bin_: list[int]) -> list[int]:
        """Close a bin: by one or two documents that fit exactly, else by the largest that fits, again and again."""
        gap = self.capacity - sum(bin_)
        while gap and (fitting := self.mask & ((2 << gap) - 1)):
            if self.mask >> gap & 1:
                bin_.append(self.take(gap))
                break
            # bit x: both x and gap - x are left
            pairs = self.mask & (self.mirror >> (self.capacity - gap))
            if not gap % 2 and self.left[gap // 2] < 2:
                pairs &= ~(1 << (gap // 2))
            if pairs:
                x = pairs.bit_length() - 1
                bin_ += [self.take(x), self.take(gap - x)]
                break
            bin_.append(self.take(x := fitting.bit_length() - 1))
            gap -= x
        return bin_

    def rest(self) -> list[list[int]]:
        out = []
        while self.mask:
            out.append(self.fill([self.take(self.mask.bit_length() - 1)]))
        return out


def fitness(bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then fuller bins."""
    return len(bins), -sum((sum(b) / capacity) ** 2 for b in bins)


def cross(into: list[list[int]], other: list[list[int]], lengths: list[int], capacity: int, dice: random.Random) -> list[list[int]]:
    fit = Fitter(lengths, capacity)
    full = [b for b in other if sum(b) == capacity] or sorted(other, key=sum)[-1:]
    child = [list(b) for b in full if dice.random() < 0.5 and fit.takes(b)]
    kept = sorted(into, key=sum, reverse=True)
    # poorly filled bins of the first parent are given up along with those that use a document twice
    child += [list(b) for b in kept if capacity - sum(b) <= capacity // 64 and fit.takes(b)]
    return child + fit.rest()


def seed(lengths: list[int], capacity: int, dice: random.Random) -> list[list[int]]:
    """Best fit after a random share of bins were begun with a random document."""
    fit = Fitter(lengths, capacity)
    begun = dice.sample(lengths, min(len(lengths), dice.randrange(len(lengths) // 8 + 1)))
    out = [fit.fill([fit.take(x)]) for x in begun if fit.left[x]]
    return out + fit.rest()


def folded(bins: list[list[int]]) -> list[int]:
    """Bins in one list, each ended by a 0: Arrow's nested lists do not always survive their way to pandas."""
    return [x for b in bins for x in (*b, 0)]


def unfolded(flat: Iterable[int]) -> list[list[int]]:
    out: list[list[int]] = [[]]
    for x in flat:
        if x:
            out[-1].append(int(x))
        else:
            out.append([])
    return out[:-1]


def fewest(lengths: list[int], capacity: int) -> int:
    """No packing has fewer bins: all lengths must fit, and no two over half can share one."""
    large = sum(x > capacity / 2 for x in lengths)
    half = sum(x == capacity / 2 for x in lengths)
    return max(-(-sum(lengths) // capacity), large + -(-half // 2))


def evolve(lengths: list[int], capacity: int, dice: random.Random, elites: list[list[list[int]]], population: int = POPULATION, generations: int = GENERATIONS) -> list[list[int]]:
    """The best packing found.  Ends as soon as no packing could have fewer bins."""
    least = fewest(lengths, capacity)
    people = [list(e) for e in elites] or [Fitter(lengths, capacity).rest()]
    best = min(people, key=lambda p: fitness(p, capacity))
    if len(best) <= least:
        return best
    people += [seed(lengths, capacity, dice) for _ in range(population - len(people))]
    for _ in range(generations):
        people.sort(key=lambda p: fitness(p, capacity))
        if len(people[0]) <= least:
            break
        people[population // 2 :] = [cross(people[0], dice.choice(people[1:]), lengths, capacity, dice) for _ in range(population - population // 2)]
    return min(people, key=lambda p: fitness(p, capacity))


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids, cut if over `capacity`; the first piece takes the remainder."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(bpe.ids(text), np.uint32(end_id)).astype("<u4")
                start, first = 0, len(ids) % capacity or capacity
                bounds = [first, *range(first + capacity, len(ids) + 1, capacity)]
                for piece, end in enumerate(bounds):
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start = end
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInPandas(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, rounds: int = ROUNDS) -> DataFrame:
    """Add sequence_id and offset to `pieces`, a table of documents' parts with a `length` of 1 to `capacity`.

    Full pieces are sequences by themselves.  The others are packed in shards of about
    `shard` pieces, dealt by a hash of the row, so no key can make a shard large, and a
    shard's lengths (not its texts) fit in one task.  A table of equal rows is packed
    like any other.  An empty table gives an empty result.
    """
    pieces = settle(pieces.withColumn("_row", F.monotonically_increasing_id()))
    n = pieces.filter(F.col("length") < capacity).count()
    shards = max(1, round(n / shard))
    full = pieces.filter(F.col("length") == capacity).select(
        *[c for c in pieces.columns if c != "_row"], (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    part = pieces.filter(F.col("length") < capacity).withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                lengths = [int(x) for x, n in zip(r.sizes, r.counts, strict=True) for _ in range(n)]
                elites = [unfolded(e) for e in (r.best, r.guest) if len(e)]
                best = evolve(lengths, capacity, random.Random(f"{r.shard}/{r.island}/{r.round}"), elites)
                out.append((r.shard, r.island, r.sizes, r.counts, folded(best), len(best)))
            yield pd.DataFrame(out, columns=["shard", "island", "sizes", "counts", "best", "bins"])

    shape = "shard long, island int, sizes array<int>, counts array<int>, best array<int>, bins int"
    nothing = F.array().cast("array<int>")
    histogram = part.groupBy("_shard", F.col("length").cast("int").alias("size")).agg(F.count("*").cast("int").alias("n"))
    # at most `capacity` sizes a shard
    lists = histogram.groupBy(F.col("_shard").alias("shard")).agg(F.sort_array(F.collect_list(F.struct("size", "n"))).alias("s"))
    state = lists.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("s.size").alias("sizes"), F.col("s.n").alias("counts"),
        nothing.alias("best"), nothing.alias("guest"),
    )
    tasks = min(shards * islands, 4096)
    for k in range(rounds):
        state = settle(state.withColumn("round", F.lit(k)).repartition(tasks, "shard", "island").mapInPandas(run, shape))
        if k + 1 < rounds:
            came = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("best").alias("guest"))
            state = state.join(came, ["shard", "island"]).select("shard", "island", "sizes", "counts", "best", "guest")
    winners = state.groupBy("shard").agg(F.min_by("best", F.struct("bins", "island")).alias("best"))
    along = Window.partitionBy("shard").orderBy("at")
    items = winners.select("shard", F.posexplode("best").alias("at", "size")).withColumn("bin", F.count_if(F.col("size") == 0).over(along)).filter("size > 0")
    placed = items.select(
        "shard", F.col("size").cast("long").alias("length"), (F.col("shard") * (1 << 32) + F.col("bin")).alias("sequence_id"),
        (F.sum("size").over(Window.partitionBy("shard", "bin").orderBy("at")) - F.col("size")).cast("long").alias("offset"),
    ).withColumn("_k", F.row_number().over(Window.partitionBy("shard", "length").orderBy("sequence_id", "offset")))
    ranked = part.withColumn("_k", F.row_number().over(Window.partitionBy("_shard", "length").orderBy("_row"))).withColumnRenamed("_shard", "shard")
    small = ranked.join(placed, ["shard", "length", "_k"]).select(full.columns)
    return full.unionByName(small)


def packed(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pack whole `docs`: one row a piece with its sequence and its place there.

    Null and empty texts are one piece holding only `end_id`.  Rows are packed as they
    are: repeated rows and null ids get pieces of their own.  Other columns are ignored.
    """
    return pack(pieces_of(docs, capacity, end_id, vocabulary), capacity)

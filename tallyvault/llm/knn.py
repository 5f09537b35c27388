"""Nearest neighbours by inner product.

Method: block matrix join.  Vectors are quantised to int8 with a scale each.  Queries
and candidates are dealt into blocks, and each pair of blocks is a tile: the product of
its int8 matrices gives every score to within a bound that follows from the rounding,
so a candidate whose upper bound is under the k-th best lower bound is out, first in its
tile and then over all tiles of its query.  Only int8 rows go to tiles; the original
vectors are fetched for the survivors alone, which are scored in double precision and
merged by heaps.  The result is exact.

Skew: rows with one id and one vector are one candidate with a count, and equal vectors
score equally, so of a set of equal candidates only the k with the least ids can be among
the nearest, and the rest leave the tile at once.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvault.llm.common import parts, settle

K = 20
#: Vectors of a block.  A task holds one block of candidates and one of queries.
QUERY_BLOCK = 2_048
CANDIDATE_BLOCK = 8_192
STRIP = 128
#: Rows that are held before they are cut to what can be among the nearest, or written.
PENDING = 8_192
T = TypeVar("T")


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the sums of their absolute values."""
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = 1
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.abs(q.astype(np.int32)).sum(1).astype(np.float64)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, summed from the first component to the last."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def representatives(ids: np.ndarray, same: np.ndarray, keep: int) -> np.ndarray:
    """Of each set of rows with an equal `same` the places of those with the `keep` least ids."""
    by = np.lexsort((ids, same))
    group = same[by]
    first = np.searchsorted(group, group, side="left")
    return np.sort(by[np.arange(len(by)) - first < keep])


def bounded(query_ids: np.ndarray, q: np.ndarray, q_scale: np.ndarray, ids: np.ndarray, c: np.ndarray, c_scale: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Each query with the places of a tile's candidates that may be among its k nearest, and their scores' lower and upper bounds."""
    q_sum, c_sum = (np.abs(x.astype(np.int32)).sum(1).astype(np.float64) for x in (q, c))
    # whole numbers under 2**24 are exact in float32, so the product of int8 matrices may use it
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    ct = np.ascontiguousarray(c.T.astype(kind))
    for at in range(0, len(q), STRIP):
        end = min(at + STRIP, len(q))
        rough = (q[at:end].astype(kind) @ ct).astype(np.float64)
        slack = 0.5 * (q_sum[at:end, None] + c_sum[None, :]) + 0.25 * q.shape[1]
        scale = q_scale[at:end, None] * c_scale[None, :]
        # a trifle more for the rounding of the double products themselves
        slack = slack * scale * (1 + 1e-9) + 1e-12 * np.abs(rough * scale)
        rough *= scale
        own = ids[None, :] == query_ids[at:end, None]
        low = np.where(own, -np.inf, rough - slack)
        least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
        kept = (rough + slack >= least[:, None]) & ~own
        for i in range(end - at):
            col = np.flatnonzero(kept[i])
            yield int(query_ids[at + i]), col, low[i, col], (rough + slack)[i, col]


class Survivors:
    """What may be among a query's k nearest, from bounds that come tile by tile."""

    def __init__(self, k: int):
        self.k, self.lows, self.rows, self.n = k, [], [], 0

    def add(self, ids: np.ndarray, same: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        for x in low:
            if len(self.lows) < self.k:
                heapq.heappush(self.lows, x)
            elif x > self.lows[0]:
                heapq.heapreplace(self.lows, x)
        self.rows.append((ids, same, high))
        self.n += len(ids)
        if self.n > PENDING:
            self.left()

    def left(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, same, high = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        if len(self.lows) == self.k:
            fit = high >= self.lows[0]
            ids, same, high = ids[fit], same[fit], high[fit]
        kept = representatives(ids, same, self.k + 1)
        self.rows = [(ids[kept], same[kept], high[kept])]
        self.n = len(kept)
        return self.rows[0]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec of the vectors that take part: not null, not zero, every component finite."""
    vec = F.col("embedding").cast("array<double>")
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
        .filter("vec_id is not null and vec is not null")
        .filter("forall(vec, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(vec, v -> v <> 0)")
    )


def nearest(vectors: DataFrame, is_query: str, k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the `k` nearest of each query.

    `vectors` has vec_id and embedding; `is_query` is a SQL predicate on vec_id.  All
    candidates but the query's own id are searched; fewer than `k` are all returned, in
    ties the least ids first.  Vectors that are null, zero, or hold a null or non-finite
    component take no part, nor do rows without an id.  Vectors of different lengths are
    never compared.  Of rows with one vec_id each is a candidate, and the query's vector
    is the greatest of them.  Other columns are ignored; an empty table gives no rows.
    """
    # a hash tells an id's vectors apart; a row is left out as one of many equal ones only where over k + 1 share theirs
    told = usable(vectors).withColumn("dim", F.size("vec")).withColumn("same", F.xxhash64("vec"))
    kept = settle(told.groupBy("vec_id", "dim", "same").agg(F.first("vec").alias("vec"), F.count("*").alias("n")))
    n = kept.count()
    queries = settle(kept.filter(is_query).groupBy("vec_id", "dim").agg(F.max("vec").alias("vec")))
    rows, columns = max(1, -(-queries.count() // query_block)), max(1, -(-n // candidate_block))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes, scales = [], []
            for v in batch["vec"]:
                q, scale, _ = quantised(np.asarray(v, np.float64)[None, :])
                codes.append(q.tobytes())
                scales.append(scale[0])
            yield batch.drop(columns="vec").assign(q=codes, scale=np.array(scales, np.float64))

    def dealt(frame: DataFrame, key: Column, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return frame.withColumn(own, F.pmod(key, F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    # a block goes by the row, not by the id alone, which many rows may share
    coded = queries.mapInPandas(code, "vec_id long, dim int, q binary, scale double")
    sides = dealt(coded, F.xxhash64(F.lit("i"), "vec_id"), "i", rows, "j", columns)
    coded = kept.drop("n").select("vec_id", "dim", "same", "vec").mapInPandas(code, "vec_id long, dim int, same long, q binary, scale double")
    others = dealt(coded, F.xxhash64(F.lit("j"), "vec_id", "same"), "j", columns, "i", rows)

    def tile(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            own = representatives(c["vec_id"].to_numpy(), c["same"].to_numpy(), k + 1)
            c = c.iloc[own]
            ids, same, dim = c["vec_id"].to_numpy(), c["same"].to_numpy(), int(q["dim"].iloc[0])
            a, b = (np.frombuffer(b"".join(x["q"]), np.int8).reshape(len(x), dim) for x in (q, c))
            out = [(query, ids[at], same[at], low, high) for query, at, low, high in bounded(q["vec_id"].to_numpy(), a, q["scale"].to_numpy(), ids, b, c["scale"].to_numpy(), k)]
        return pd.DataFrame({"query_id": np.array([o[0] for o in out], np.int64)} | {name: pd.Series([o[i] for o in out], dtype=object) for i, name in enumerate(("vec_ids", "sames", "lows", "highs"), 1)})

    shape = "query_id long, vec_ids array<long>, sames array<long>, lows array<double>, highs array<double>"
    keys = ["dim", "i", "j"]
    found = sides.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInPandas(tile, shape)

    def by_query(batches: Iterator[pd.DataFrame], fresh: Callable[[], T], add: Callable[[T, tuple], None]) -> Iterator[tuple[int, T]]:
        """Rows that are ordered by query, gathered a query at a time."""
        at, held = None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if held is None or r.query_id != at:
                    if held is not None:
                        yield at, held
                    at, held = r.query_id, fresh()
                add(held, r)
        if held is not None:
            yield at, held

    def chunked(rows: Iterator[pd.DataFrame], empty: list[str]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for r in rows:
            held.append(r)
            size += len(r)
            if size >= PENDING:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
        yield pd.concat(held, ignore_index=True) if held else pd.DataFrame(columns=empty)

    def surviving(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out() -> Iterator[pd.DataFrame]:
            for query, s in by_query(batches, lambda: Survivors(k), lambda s, r: s.add(np.asarray(r.vec_ids, np.int64), np.asarray(r.sames, np.int64), np.asarray(r.lows, np.float64), np.asarray(r.highs, np.float64))):
                ids, same, _ = s.left()
                yield pd.DataFrame({"query_id": np.full(len(ids), query, np.int64), "vec_id": ids, "same": same})

        yield from chunked(out(), ["query_id", "vec_id", "same"])

    ordered = found.repartition(parts(found), "query_id").sortWithinPartitions("query_id")
    pairs = settle(ordered.mapInPandas(surviving, "query_id long, vec_id long, same long"))
    fetched = pairs.join(kept.select("vec_id", "same", "dim", "vec", "n"), ["vec_id", "same"]).join(queries.select(F.col("vec_id").alias("query_id"), "dim", F.col("vec").alias("own")), ["query_id", "dim"])

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = np.empty(len(batch))
            for dim, rows in batch.groupby("dim").indices.items():
                s[rows] = exact(np.stack(batch["own"].to_numpy()[rows]).reshape(len(rows), dim), np.stack(batch["vec"].to_numpy()[rows]).reshape(len(rows), dim))
            yield batch[["query_id", "vec_id", "n"]].assign(score=s)

    scores = fetched.select("query_id", "vec_id", "n", "dim", "own", "vec").mapInPandas(scored, "query_id long, vec_id long, n long, score double")

    def keep(heap: list[tuple[float, int]], r: tuple) -> None:
        """The k best so far; a row that stands for several counts as often."""
        item = (float(r.score), -int(r.vec_id))
        for _ in range(min(k, int(r.n))):
            if len(heap) < k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out() -> Iterator[pd.DataFrame]:
            for query, heap in by_query(batches, list, keep):
                ranked = sorted((-s, -i) for s, i in heap)
                yield pd.DataFrame([(query, r, i, -s) for r, (s, i) in enumerate(ranked, 1)], columns=["query_id", "rank", "vec_id", "score"])

        yield from chunked(out(), ["query_id", "rank", "vec_id", "score"])

    ordered = scores.repartition(parts(scores), "query_id").sortWithinPartitions("query_id")
    return ordered.mapInPandas(merge, "query_id long, rank int, vec_id long, score double")

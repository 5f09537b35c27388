"""Groups of rows in bounded tiles, and connected components, without gathering anything on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvault.llm.common import parts, settle


def tiled(rows: DataFrame, key: str, member: str, size: str, block: int) -> DataFrame:
    """Deal each group's members into blocks of about `block` by hash and give each pair of blocks a tile.

    Adds _i and _j (the tile, _i <= _j) and _block (the member's own block).  A group of
    up to `block` members is one tile.  A tile holds about two blocks, whatever the group's size.
    """
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(F.lit(17), F.col(member)), blocks).cast("int")
    return (
        rows.withColumn("_block", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("_i", F.least("_block", "_other"))
        .withColumn("_j", F.greatest("_block", "_other"))
        .drop("_other")
    )


def by_group(rows: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """Apply `work` to each group of `keys`; groups are whole and bounded, and small ones share a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def groups(frame: pd.DataFrame, last: bool) -> tuple[list[pd.DataFrame], pd.DataFrame | None]:
            values = [frame[k].to_numpy() for k in keys]
            change = np.zeros(len(frame), bool)
            for v in values:
                change[1:] |= v[1:] != v[:-1]
            cuts = [0, *np.flatnonzero(change), len(frame)]
            whole = [frame.iloc[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return (whole, None) if last else (whole[:-1], whole[-1])

        def worked(whole: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = [x for x in map(work, whole) if x is not None and len(x)]
            if found:
                yield pd.concat(found, ignore_index=True)

        for batch in batches:
            if not len(batch):
                continue
            frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            whole, rest = groups(frame, last=False)
            yield from worked(whole)
        if rest is not None:
            yield from worked(groups(rest, last=True)[0])

    return rows.repartition(parts(rows), *keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each of n nodes' component, for the edges a-b."""
    root = np.arange(n)
    while len(a):
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            break
    return root


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for `edges` (a, b).

    Least labels spread along the edges and jump to their label's label, so the rounds
    grow with the logarithm of the diameter.  Each round ends in a checkpoint.
    """
    both = settle(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label"))
    while True:
        labels = settle(labels)
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("label").alias("up"))
        jumped = spread.join(up, "next").select("node", F.least("next", "up").alias("next"), "label")
        after = settle(jumped)
        labels = after.select("node", F.col("next").alias("label"))
        if after.filter("next <> label").isEmpty():
            return labels

"""Rows joined to the facts of a group, where one group may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: So many of the largest groups are joined by broadcast; any other has at most this share of all rows.
HOT = 1_000


def joined(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, spread: list[str], keep: bool = False, most: int | None = None) -> DataFrame:
    """Rows with the facts (a row a group, `size` of them its number of rows) of their keys; rows without facts go, or are kept without.

    Facts are an aggregate by the same keys, so Spark would deal all rows of a group to the
    task that has its facts, and adaptive execution splits no partition that comes out of
    an aggregate.  Here the largest groups' facts are broadcast, a number that does not grow with
    the data.  Their rows, and those that lack a key, are dealt by `spread` in the join that finds the other groups' facts.
    """
    others = [c for c in facts.columns if c not in keys]
    told = F.struct(*others)
    top = facts.orderBy(F.desc(size)).limit(HOT if most is None else most).select(*keys, told.alias("_hot"))
    marked = rows.join(F.broadcast(top), keys, "left")
    *first, last = keys
    away = F.xxhash64(*spread)
    if isinstance(rows.schema[last].dataType, StringType):
        away = F.concat(F.lit("#"), away.cast("string"))
    dealt = marked.withColumn("_key", F.when(F.col("_hot").isNotNull() | F.col(last).isNull(), away).otherwise(F.col(last)))
    cold = facts.select(*first, F.col(last).alias("_key"), told.alias("_cold"))
    # what a hot row meets by its spread key, if anything, does not count
    found = dealt.join(cold, [*first, "_key"], "left").withColumn("_told", F.when(F.col(last).isNotNull(), F.coalesce("_hot", "_cold")))
    found = found if keep else found.filter("_told is not null")
    return found.select(*rows.columns, *[F.col(f"_told.{c}").alias(c) for c in others])

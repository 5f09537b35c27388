"""Late arrivals: a dataset laid out in files by day is overwritten where late rows change it, and nowhere else.

Method: RDD secondary sort.  Rows keyed (sale_id, arrived_at) are dealt by sale_id and sorted
within their partition, and one streaming pass folds the rows of each sale_id into the
early winner (the latest of the rows that arrived before a cutoff) and the winner of all.
What the fold keeps is two rows, however many a sale_id has.  The winners are keyed (day,
sold_at, sale_id) and go through a second repartitionAndSortWithinPartitions, whose
partitions begin where files begin, so each task cuts its stream into whole files.

A sale_id that a share of all rows have is dealt by its rows' checksums and folded once
more, from two rows a task.  Where files begin comes from a sort by range of the keys, counted
by task; only one key a task goes to the driver.  Files are written by Spark's committer:
the first layout as a new dataset partitioned by day, the second by a dynamic overwrite of
the days concerned.  A lost executor's tasks are run again and leave nothing behind.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvault.llm.common import parts, placed, settle
from tallyvault.storage import new_folder, written

CUTOFF = datetime(2024, 3, 20)
FILES = 1100
#: A sale_id that so small a share of all rows have, and LEAST_HOT rows at least, is folded in two steps; there are at most HOT_SHARE of them.
HOT_SHARE = 1_000
LEAST_HOT = 1_000
DAY = 86_400_000_000
#: Sorts before every number, as null does in Spark.
NONE = -(1 << 63) - 1


def micros(name: str, kind: T.DataType) -> Column:
    """Microseconds since 1970 in UTC; times without a zone are in UTC, whatever the session's zone."""
    c = F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    since = F.expr(f"`{name}` - TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    part = lambda unit: F.extract(F.lit(unit), since)
    return part("DAY").cast("long") * DAY + part("HOUR").cast("long") * 3_600_000_000 + part("MINUTE").cast("long") * 60_000_000 + (part("SECOND") * 1_000_000).cast("long")


def time_of(name: str, kind: T.DataType) -> Column:
    """The time that `micros` came from."""
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(name)
    whole, rest = F.expr(f"`{name}` div 1000000"), F.expr(f"`{name}` % 1000000")
    second = (rest.cast("decimal(18,6)") / 1_000_000).cast("decimal(18,6)")
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(F.expr(f"cast((`{name}` div 1000000) div 86400 as int)"), F.lit(0), F.lit(0), (whole % 86_400).cast("decimal(18,6)") + second)


def day_of(sold: Column) -> Column:
    """Whole days since 1970, -1 for null."""
    return F.coalesce(F.call_function("div", sold - F.pmod(sold, F.lit(DAY)), F.lit(DAY)), F.lit(-1).cast("long"))


def _text(row: tuple) -> tuple:
    return tuple((v is not None, str(v)) for v in row)


class Fold:
    """The early winner and the winner of all of each id, in one pass over rows in the order of (id, arrived)."""

    def __init__(self, cutoff: int, hot: frozenset):
        self.cutoff, self.hot = cutoff, hot

    def __call__(self, rows: Iterator[tuple[tuple, tuple]]) -> Iterator[tuple]:
        """Winners with whether they stand at the start and at the end, and whether their id is folded once more."""
        own, early, last, at, before = None, None, None, 0, 0
        for (id_, arrived, _), row in rows:
            if own is None or id_ != own:
                yield from self._winners(own, early, last)
                own, early, last = id_, None, None
            if last is None or arrived > at or _text(row) > _text(last):
                last, at = row, arrived
            if NONE < arrived < self.cutoff and (early is None or arrived > before or _text(row) > _text(early)):
                early, before = row, arrived
        yield from self._winners(own, early, last)

    def _winners(self, own: int | None, early: tuple | None, last: tuple | None) -> Iterator[tuple]:
        if last is None:
            return
        again = own in self.hot
        if early is last:
            yield (*last, True, True, again)
            return
        if early is not None:
            yield (*early, True, False, again)
        yield (*last, False, True, again)


def winners(rows: DataFrame, id_at: int, arrived_at: int, cutoff: int, folder: str, hot_share: int = HOT_SHARE, least_hot: int = LEAST_HOT) -> DataFrame:
    """The rows that a sale_id keeps, with __tv_start and __tv_final (whether they stand at the start and at the end); columns that are times are microseconds.

    Of rows that arrived at the same time the one whose values, as text, come last is kept; a
    row without an arrival is late and comes before all others; a null id is an id.
    """
    spark, n = rows.sparkSession, parts(rows)
    counts = rows.groupBy(F.col(rows.columns[id_at]).alias("id")).agg(F.count("*").alias("n"))
    least = max(least_hot, rows.count() // hot_share)
    hot = frozenset(NONE if r["id"] is None else r["id"] for r in counts.filter(F.col("n") >= least).collect())  # at most hot_share
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.BooleanType(), False) for c in ("__tv_start", "__tv_final", "__tv_again"))])

    def keyed(row: tuple) -> tuple[tuple, tuple]:
        id_, arrived = row[id_at], row[arrived_at]
        id_ = NONE if id_ is None else id_
        return (id_, NONE if arrived is None else arrived, zlib.crc32(repr(row).encode()) if id_ in hot else 0), row

    def dealt(key: tuple) -> int:
        return (key[0] * 0x9E3779B1 >> 7) + key[2]

    def folded(keyed_rows, again: frozenset, target: str) -> DataFrame:  # noqa: ANN001
        sorted_ = keyed_rows.repartitionAndSortWithinPartitions(n, dealt)
        return written(spark.createDataFrame(sorted_.mapPartitions(Fold(cutoff, again)), schema, verifySchema=False), target)

    first = folded(rows.rdd.map(lambda r: keyed(tuple(r))), hot, f"{folder}/winners")
    if not hot:
        return first.drop("__tv_again")
    width = len(rows.columns)

    def without_salt(row: tuple) -> tuple[tuple, tuple]:
        (id_, arrived, _), own = keyed(tuple(row)[:width])
        return (id_, arrived, 0), own

    second = folded(first.filter("__tv_again").rdd.map(without_salt), frozenset(), f"{folder}/winners-again")
    return first.filter("not __tv_again").unionByName(second).drop("__tv_again")


def _beginnings(keys: DataFrame, size: int, tasks: int) -> list[tuple]:
    """At most `tasks` keys (day, sold, id) at which files begin, the first of all among them; the files between two go to one task."""
    begin = placed(keys, "day", ["sold", "id"]).filter(F.col("__tv_place") % size == 0).select(F.lit(0).alias("all"), "day", "sold", "id")
    begin = placed(begin, "all", ["day", "sold", "id"]).withColumn("step", F.expr(f"({tasks} - 1 + __tv_size) div {tasks}"))
    chosen = begin.filter(F.col("__tv_place") % F.col("step") == 0).select("day", "sold", "id").collect()
    return sorted(tuple(NONE if v is None else v for v in r) for r in chosen)


class Layout:
    """A dataset of one folder a day, whose files hold `size` rows each in the order of (sold, id), the last of a day perhaps fewer."""

    def __init__(self, sales: DataFrame, folder: str, size: int, id_: str, sold: str):
        self.spark, self.folder, self.size, self.id, self.sold = sales.sparkSession, folder, size, id_, sold
        self.kinds = {f.name: f.dataType for f in sales.schema.fields}
        self.day = "layout_day"
        while self.day in self.kinds:
            self.day += "_"

    def write(self, rows: DataFrame, anew: bool) -> None:
        """Write rows (times as microseconds, and their day); only the days that they have, if not anew."""
        names = list(self.kinds)
        sold_at, id_at = names.index(self.sold), names.index(self.id)
        begin = _beginnings(rows.select(F.col("__tv_day").alias("day"), F.col(self.sold).alias("sold"), F.col(self.id).alias("id")), self.size, parts(rows)) or [(0, NONE, NONE)]

        def keyed(row: tuple) -> tuple[tuple, tuple]:
            sold, id_ = row[sold_at], row[id_at]
            return (row[-1], NONE if sold is None else sold, NONE if id_ is None else id_), tuple(row)

        dealt = rows.select(*names, "__tv_day").rdd.map(keyed).repartitionAndSortWithinPartitions(len(begin), lambda key: max(0, bisect_right(begin, key) - 1))
        schema = T.StructType([*rows.select(*names).schema.fields, T.StructField(self.day, T.LongType(), False)])
        ordered = self.spark.createDataFrame(dealt.values(), schema, verifySchema=False)
        # the rows are in this order, and Spark's writer has to know that they are
        ordered = ordered.sortWithinPartitions(self.day, self.sold, self.id)
        timed = ordered.select(*[time_of(n, k).alias(n) if _is_time(k) else F.col(n) for n, k in self.kinds.items()], self.day)
        writer = timed.write.partitionBy(self.day).option("maxRecordsPerFile", self.size)
        (writer if anew else writer.option("partitionOverwriteMode", "dynamic").mode("overwrite")).parquet(self.folder)

    def read(self) -> DataFrame:
        """All rows on disk with their day, file (__tv_path) and place in it (__tv_at)."""
        schema = T.StructType([*(T.StructField(n, k) for n, k in self.kinds.items()), T.StructField(self.day, T.LongType())])
        return self.spark.read.schema(schema).parquet(self.folder).select(*self.kinds, F.col(self.day), F.col("_metadata.file_path").alias("__tv_path"), F.col("_metadata.row_index").alias("__tv_at"))

    def paths(self) -> DataFrame:
        return settle(self.read().select("__tv_path").distinct())

    def remove(self, days: list[int]) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for d in days:
            at = path(f"{self.folder}/{self.day}={d}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType))


def in_micros(sales: DataFrame) -> DataFrame:
    return sales.select(*[micros(f.name, f.dataType).alias(f.name) if _is_time(f.dataType) else F.col(f.name) for f in sales.schema.fields])


def overwritten(sales: DataFrame, rows: DataFrame, size: int, cutoff: datetime = CUTOFF, id_: str = "sale_id", sold: str = "sold_at", arrived: str = "arrived_at") -> tuple[Layout, DataFrame]:
    """Lay out early rows, then make it the layout of all of `rows`; the layout, and the paths (__tv_path) it had at first.

    `rows` has the columns of `sales` with times as microseconds (see `in_micros`).  Days are
    written anew where a kept late row stands, or its sale stood at first; a day that has no
    row any more goes.  Empty tables give no files.
    """
    folder = new_folder(sales.sparkSession, "layout")
    names = list(rows.columns)
    limit = int(cutoff.replace(tzinfo=timezone.utc).timestamp() * 1_000_000)
    kept = winners(rows, names.index(id_), names.index(arrived), limit, f"{folder}-work")
    kept = kept.withColumn("__tv_day", day_of(F.col(sold)))
    layout = Layout(sales, folder, size, id_, sold)
    layout.write(kept.filter("__tv_start"), anew=True)
    first = layout.paths()
    days = settle(kept.filter("__tv_start <> __tv_final").select("__tv_day").distinct())
    final = kept.filter("__tv_final").join(days, "__tv_day", "left_semi")
    layout.write(final, anew=False)
    layout.remove([r["__tv_day"] for r in days.join(final.select("__tv_day").distinct(), "__tv_day", "left_anti").collect()])
    return layout, first


def with_late_copies(rows: DataFrame) -> DataFrame:
    """Rows (times as microseconds) and, of those whose id's checksum 3 divides and whose day 4 divides, a copy sold up to a day and arrived up to 97 days later, at one more."""
    h, day = F.crc32(F.col("sale_id").cast("string").cast("binary")), day_of(F.col("sold_at"))
    late = rows.filter((h % 3 == 0) & (day % 4 == 0)).withColumns({
        "total": F.col("total") + 1, "sold_at": F.col("sold_at") + h % 2 * DAY, "arrived_at": F.col("arrived_at") + (1 + h % 97) * DAY
    })
    return rows.unionByName(late)


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each file's ids; a file's rows come in order, one file after the other."""
    path, state = None, None
    for batch in batches:
        for own, ids in batch.groupby("__tv_path", sort=False)["id"]:
            joined = ",".join(ids)
            if own != path:
                if path is not None:
                    yield pd.DataFrame({"__tv_path": [path], "ids_sha256": [state.hexdigest()]})
                path, state = own, hashlib.sha256(joined.encode())
            else:
                state.update(f",{joined}".encode())
    if path is not None:
        yield pd.DataFrame({"__tv_path": [path], "ids_sha256": [state.hexdigest()]})


def digests(sales: DataFrame) -> DataFrame:
    """One row for each file of `sales`' layout after the overwrite, from what is on disk."""
    size = 1 + sales.count() // FILES
    layout, first = overwritten(sales, with_late_copies(in_micros(sales)), size)
    found = layout.read()
    sold, arrived, id_ = (micros("sold_at", layout.kinds["sold_at"]), micros("arrived_at", layout.kinds["arrived_at"]), F.col("sale_id").cast("string"))
    line = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in (id_, sold, arrived)])
    facts = found.groupBy(F.col(layout.day).alias("day"), "__tv_path").agg(
        F.count("*").alias("n_rows"), F.coalesce(F.sum(F.floor(100 * F.col("total") + 0.5)), F.lit(0)).cast("long").alias("cents"),
        F.sum(F.crc32(line.cast("binary"))).alias("rows_crc"), F.min(F.struct(sold.alias("sold"), F.col("sale_id").alias("id"))).alias("least"),
    )
    narrow = found.select("__tv_path", "__tv_at", F.coalesce(id_, F.lit("")).alias("id")).repartition(parts(sales), "__tv_path").sortWithinPartitions("__tv_path", "__tv_at")
    ids = narrow.select("__tv_path", "id").mapInPandas(_listed, "__tv_path string, ids_sha256 string")
    there = found.select("__tv_path").head(1)
    columns = found.sparkSession.read.parquet(there[0][0]).columns if there else list(layout.kinds)
    own = facts.join(ids, "__tv_path").join(first.withColumn("there", F.lit(True)), "__tv_path", "left")
    number = F.row_number().over(Window.partitionBy("day").orderBy("least")) - 1  # a day has as many rows here as files
    return own.select("day", number.cast("long").alias("file_no"), "n_rows", "cents", "rows_crc", F.regexp_replace("__tv_path", "^file:/+", "file:///").alias("path"), F.lit(",".join(columns)).alias("columns"), "ids_sha256", F.col("there").isNull().alias("rewritten"))

"""Line dedup: lines that many documents share are dropped from all of them.

Method: levelled sorted runs of line hashes.  A run is a table of (line, docs): the hash of
a line's key and the number of documents of some batches that have it, bucketed and sorted
by the hash.  Each new batch of documents is counted, merge-anti-joined with what the runs
already know to be common (those lines need no more counting), and adds a run of its own at
level 0.  When a level has `FANOUT` runs they are compacted into one of the next level.  A
line is common when its counts over all runs reach the limit; a count that stops once the
limit is known is at least the limit, and every other count is whole.

DataFrame and SQL functions only.  A line's key is the line without white space at both
ends and with A to Z in lower case; lines are compared by 128-bit hashes of their keys.
Counts are combined before they are shuffled, and the join of lines with the common ones
and that of texts with their places have bare shuffles on both sides, so that adaptive
execution splits a line, a document or an id that many rows have.  Texts are read to be
hashed, and once more to leave with the lines that stay.
"""

from __future__ import annotations

import re
import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvault.llm.common import parts, settle
from tallyvault.storage import new_folder

#: A key that so many documents have is common.
LEAST = 10
#: Runs of a level before they are compacted.
FANOUT = 3
#: Batches that a whole table is added in.
BATCHES = 6
_SPACE = " \t\n\x0b\x0c\r"


def key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def lines(text: Column) -> Column:
    """A null text is one empty line, like an empty one."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def hashes(text: Column) -> Column:
    """The hash of each line's key, null for an empty key."""
    return F.transform(F.transform(lines(text), key), lambda k: F.when(k != "", F.md5(k)))


class Runs:
    """Levelled runs in a folder of the shared one; one writer at a time, and other sessions may `reopen` it."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int, least: int = LEAST, fanout: int = FANOUT):
        self.spark, self.folder, self.buckets, self.least, self.fanout = spark, folder.rstrip("/"), buckets, least, fanout
        self.levels: list[list[str]] = []

    @classmethod
    def reopen(cls, spark: SparkSession, folder: str, buckets: int, least: int = LEAST, fanout: int = FANOUT) -> Runs:
        """The runs that a folder has: of each level those that no finished run of a higher level was made of."""
        runs = cls(spark, folder, buckets, least, fanout)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(runs.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [str(f.getPath().getName()) for f in fs.listStatus(path(runs.folder))] if fs.exists(path(runs.folder)) else []
        whole = {n for n in found if fs.exists(path(f"{runs.folder}/{n}/_SUCCESS"))}
        named = [(m, n) for n in whole if (m := re.fullmatch(r"run-(\d+)-(\d+)-(\d+)", n))]
        covered = [(int(m[1]), int(m[2]), int(m[3])) for m, _ in named]
        for m, n in sorted(named, key=lambda x: (int(x[0][1]), int(x[0][2]))):
            level, first, last = int(m[1]), int(m[2]), int(m[3])
            if not any(high > level and a <= first and last <= b for high, a, b in covered):
                while len(runs.levels) <= level:
                    runs.levels.append([])
                runs.levels[level].append(n)
        return runs

    def _table(self, run: str) -> DataFrame:
        """A run as a bucketed table, so that joins on the hash need no shuffle of it."""
        name = f"tallyvault_{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.folder}/{run}').hex}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} (line STRING, docs BIGINT) USING parquet CLUSTERED BY (line) SORTED BY (line) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{run}'")
        return self.spark.table(name)

    def _write(self, counts: DataFrame, level: int, first: int, last: int) -> None:
        run = f"run-{level}-{first}-{last}"
        name = f"tallyvault_{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.folder}/{run}').hex}"
        dealt = counts.repartition(self.buckets, "line").sortWithinPartitions("line")
        dealt.write.bucketBy(self.buckets, "line").sortBy("line").option("path", f"{self.folder}/{run}").format("parquet").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def tables(self) -> list[DataFrame]:
        return [self._table(r) for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> None:
        """Count the distinct lines of a batch of documents, one row of `hashes` a document; its run is level 0's newest."""
        counts = batch.select(F.explode(F.array_distinct("hashes")).alias("line")).filter("line is not null").groupBy("line").agg(F.count("*").alias("docs"))
        for known in self.tables():
            counts = counts.join(known.filter(F.col("docs") >= self.least).hint("merge"), "line", "left_anti")
        n = 1 + max((int(r.rpartition("-")[2]) for level in self.levels for r in level), default=-1)
        self._write(counts, 0, n, n)
        self._compact()

    def _compact(self) -> None:
        for level in range(len(self.levels)):
            full = self.levels[level] if level < len(self.levels) else []
            if len(full) < self.fanout:
                continue
            self._write(self._summed([self._table(r) for r in full]), level + 1, *self._span(full))
            self.levels[level] = []

    @staticmethod
    def _span(runs: list[str]) -> tuple[int, int]:
        ends = [tuple(map(int, r.split("-")[2:])) for r in runs]
        return min(a for a, _ in ends), max(b for _, b in ends)

    @staticmethod
    def _summed(tables: list[DataFrame]) -> DataFrame:
        """Runs merged by their sorted hashes.  (A union of bucketed tables must not be grouped here: Spark 4.1 takes it for co-located, and it is not.)"""
        out = tables[0]
        for t in tables[1:]:
            more = t.withColumnRenamed("docs", "more").hint("merge")
            out = out.join(more, "line", "full_outer").select("line", (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs"))
        return out

    def common(self) -> DataFrame:
        """The lines that are common over all batches so far."""
        if not any(self.levels):
            return self.spark.createDataFrame([], "line string")
        return self._summed(self.tables()).filter(F.col("docs") >= self.least).select("line")


def marked(docs: DataFrame, least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """`docs` with __tv_kept (the text that stays), __tv_lines and __tv_dropped (counts of lines).

    The table is added to the runs in `batches`, and lines are dropped by what all of them
    know.  Every row is a document, so repeated rows count each; null and empty texts are one
    empty line, which stays; keys of white space alone stay; a text all of whose lines go is
    empty; an empty table gives an empty result.  Other columns stay as they are.
    """
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "lines")
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    id_, text_hash = F.col("doc_id").cast("string").alias("id"), F.xxhash64(body).alias("text_hash")
    staged = docs.select(id_, text_hash, hashes(F.col("text")).alias("hashes")).withColumn("batch", F.pmod(F.xxhash64("id", "text_hash"), F.lit(batches)).cast("int"))
    staged.write.partitionBy("batch").parquet(f"{folder}/hashes")
    whole = spark.read.schema("id string, text_hash long, hashes array<string>, batch int").parquet(f"{folder}/hashes")
    runs = Runs(spark, f"{folder}/runs", parts(docs), least, fanout)
    for i in range(batches):
        runs.add(whole.filter(F.col("batch") == i))
    common = settle(runs.common())
    found = whole.select("id", "text_hash", F.posexplode("hashes").alias("at", "line")).filter("line is not null").join(common, "line", "left_semi")
    # texts that are equal lose equal places, so rows of one id and hash share a row here
    places = settle(found.groupBy("id", "text_hash").agg(F.collect_set("at").alias("__tv_places")).withColumnsRenamed({"id": "__tv_id", "text_hash": "__tv_hash"}))
    same = F.col("doc_id").cast("string").eqNullSafe(F.col("__tv_id")) & (F.xxhash64(body) == F.col("__tv_hash"))
    split = docs.join(places, same, "left").drop("__tv_id", "__tv_hash").withColumn("__tv_split", lines(F.col("text")))
    n = F.size("__tv_split")
    stay = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), "__tv_places"), lambda i: F.col("__tv_split")[i])
    kept = F.when(F.col("__tv_places").isNull(), body).otherwise(F.array_join(stay, "\n"))
    dropped = F.when(F.col("__tv_places").isNull(), 0).otherwise(F.size("__tv_places"))
    return split.select(*docs.columns, kept.alias("__tv_kept"), n.cast("long").alias("__tv_lines"), dropped.cast("long").alias("__tv_dropped"))


def deduplicated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """`docs` without the lines that at least `least` documents share; texts without such lines stay as they are, null ones too."""
    gone = F.when(F.col("__tv_dropped") > 0, F.col("__tv_kept")).otherwise(F.col("text"))
    return marked(docs, least).withColumn("text", gone).select(*docs.columns)


def digests(docs: DataFrame, least: int = LEAST) -> DataFrame:
    return marked(docs, least).select("doc_id", F.col("__tv_lines").alias("n_lines"), F.col("__tv_dropped").alias("n_dropped"), F.sha2("__tv_kept", 256).alias("kept_sha256"))

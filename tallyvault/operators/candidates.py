"""Which files to hash, and how new digests join the stored ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvault.errors import Refused
from tallyvault.functions.text import digest
from tallyvault.inventory import Inventory
from tallyvault.operators import hot
from tallyvault.storage import numbered


def to_hash(inv: Inventory, scan_id: int, rehash: bool = False, complete: bool = False) -> DataFrame:
    """Files of a scan to hash: of the unhashed those whose size repeats in the scan (or all), and on request the hashed."""
    files = inv.entries.filter((F.col("scan_id") == scan_id) & (F.col("kind") == "FILE"))
    known = files.join(inv.hashes.filter(F.col("scan_id") == scan_id), ["scan_id", "entry_id"], "left")
    known = hot.joined(known, files.groupBy("size").agg(F.count("*").alias("_n")), ["size"], "_n", ["scan_id", "entry_id"])
    unhashed = F.col("sha256").isNull() & (F.lit(complete) | (F.col("_n") > 1))
    return known.filter(unhashed | (F.lit(rehash) & F.col("sha256").isNotNull())).select("scan_id", "entry_id", "relative_path", "size", "modified_sec", "modified_nano", "sha256")


def selected(inv: Inventory, names: list[str]) -> DataFrame:
    """scan_id and ordinal of the named scans, in the order asked for; refused unless they can be compared."""
    if not names or len(names) < 2 or len(set(names)) != len(names) or any(not n or not n.strip() for n in names):
        raise Refused("two or more different scans are needed", "INVALID_FILTER")
    found = {r["name"]: r for r in inv.scans.filter(F.col("name").isin(names)).collect()}
    for n in names:
        if n not in found:
            raise Refused(f"no scan is named {n!r}", "SCAN_NOT_FOUND")
        if found[n]["phase"] not in ("READY", "HASHING", "COMPLETE", "COMPLETE_WITH_ERRORS") or found[n]["active_dir"] is not None:
            raise Refused(f"{n!r} is not discovered to its end", "INVALID_INVENTORY")
        if found[n]["algorithm"] != "SHA-256":
            raise Refused(f"{n!r} has other digests", "UNSUPPORTED_ALGORITHM")
    chosen = inv.spark.createDataFrame([(found[n]["scan_id"], i) for i, n in enumerate(names)], "scan_id long, scan_ordinal int")
    ids = [found[n]["scan_id"] for n in names]
    # one job for all audits
    wrong = reduce(DataFrame.unionByName, [bad.limit(1).select(F.lit(i).alias("n"), F.lit(what).alias("what")) for i, (what, bad) in enumerate(audits(inv, ids).items())]).collect()
    if wrong:
        raise Refused(min(wrong)["what"], "INVALID_INVENTORY")
    return chosen


def audits(inv: Inventory, scan_ids: list[int]) -> dict[str, DataFrame]:
    """What must be empty before scans are compared."""
    entries, hashes = (t.filter(F.col("scan_id").isin(scan_ids)) for t in (inv.entries, inv.hashes))
    files = entries.filter("kind = 'FILE'")
    return {
        "an entry is stored twice": entries.groupBy("scan_id", "entry_id").count().filter("count > 1"),
        "a digest is stored twice": hashes.groupBy("scan_id", "entry_id").count().filter("count > 1"),
        "a digest is no SHA-256": hashes.filter(~F.coalesce(digest(F.col("sha256")), F.lit(False))),
        "a digest is of no file": hashes.join(files, ["scan_id", "entry_id"], "left_anti"),
    }


def cross_sizes(inv: Inventory, chosen: DataFrame) -> DataFrame:
    """Sizes that files of two or more of the chosen scans have."""
    files = inv.entries.filter("kind = 'FILE'").join(F.broadcast(chosen), "scan_id", "left_semi")
    return files.groupBy("size").agg(F.count_distinct("scan_id").alias("scan_count"), F.count("*").alias("files")).filter("scan_count >= 2")


def cross_candidates(inv: Inventory, chosen: DataFrame) -> DataFrame:
    """Files of such sizes with their digest, if any."""
    files = inv.entries.filter("kind = 'FILE'").join(F.broadcast(chosen), "scan_id")
    gated = hot.joined(files, cross_sizes(inv, chosen).select("size", "files"), ["size"], "files", ["scan_id", "entry_id"])
    return gated.join(inv.hashes, ["scan_id", "entry_id"], "left").select("scan_id", "entry_id", "scan_ordinal", "relative_path", "size", "sha256")


def cross_counters(inv: Inventory, chosen: DataFrame) -> DataFrame:
    return cross_candidates(inv, chosen).agg(
        F.count("*").alias("candidate_files"), F.count("sha256").alias("existing_hashes"), F.count_if(F.col("sha256").isNull()).alias("pending_files")
    )


def absent(incoming: DataFrame, stored: DataFrame, allowed: DataFrame) -> DataFrame:
    """The incoming digests that are not stored yet; refused if one is of no candidate, or differs from what is stored."""
    key = ["scan_id", "entry_id"]
    if not incoming.join(allowed, key, "left_anti").isEmpty():
        raise Refused("a digest is of no candidate", "INVALID_INVENTORY")
    known = incoming.join(stored.withColumnRenamed("sha256", "_stored"), key)
    if not known.filter("sha256 <> _stored").isEmpty() or not incoming.groupBy(*key).agg(F.count_distinct("sha256").alias("n")).filter("n > 1").isEmpty():
        raise Refused("a digest contradicts another", "INVALID_INVENTORY")
    return incoming.dropDuplicates(key).join(stored, key, "left_anti")


def upserted(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored digests with new ones put in their place or added; a file whose new hash failed keeps its old digest."""
    new = fresh.select("scan_id", "entry_id", F.col("sha256").alias("_new"))
    return stored.join(new, ["scan_id", "entry_id"], "full_outer").select("scan_id", "entry_id", F.coalesce("_new", "sha256").alias("sha256"))


def unfinished_directories(inv: Inventory, scan_id: int, limit: int | None = 1000) -> DataFrame:
    """The next directories to walk, or all: not done, under a parent that is done, in the order they were met."""
    queue = inv.directories.filter(F.col("scan_id") == scan_id)
    parents = queue.select(F.col("entry_id").alias("parent_id"), F.col("completed").alias("_done"))
    open_ = queue.filter("not completed").join(parents, "parent_id", "left").filter("parent_id = 0 or _done")
    return (open_ if limit is None else open_.orderBy("entry_id").limit(limit)).select("scan_id", "entry_id", "parent_id", "relative_path")


def without_partial_walk(inv: Inventory, scan_id: int) -> DataFrame:
    """Entries without what an interrupted walk of the scan's active directory had recorded."""
    active = inv.scans.filter((F.col("scan_id") == scan_id) & F.col("active_dir").isNotNull()).select("scan_id", F.col("active_dir").alias("parent_id"))
    return inv.entries.join(F.broadcast(active), ["scan_id", "parent_id"], "left_anti")


def sequence_page(files: DataFrame, order: list[str], after: int, limit: int) -> DataFrame:
    """Of files numbered from 1 in an order those past `after`, `limit` at most: candidates of a scan or of its archives by
    entry, of several scans by ordinal and entry."""
    return numbered(files, order).filter((F.col("sequence") > after) & (F.col("sequence") <= after + limit))

"""Confirmed copies: same size and same SHA-256, in one scan, across scans, and in groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvault import cursor, spec
from tallyvault.errors import InvalidFilter, Refused
from tallyvault.functions import paths
from tallyvault.inventory import Inventory, scan
from tallyvault.operators import candidates, contents, hot
from tallyvault.operators import predicates as P
from tallyvault.schemas import SCHEMAS
from tallyvault.storage import settle

DONE = ("COMPLETE", "COMPLETE_WITH_ERRORS")


def hashed_files(inv: Inventory) -> DataFrame:
    return inv.entries.filter("kind = 'FILE'").join(inv.hashes, ["scan_id", "entry_id"])


def with_counts(files: DataFrame, counts: list[Column], kept: Column) -> DataFrame:
    """Files of the contents whose counts (`copies` among them) pass `kept`, with the counts.

    The counts are combined before they are shuffled and joined back so that a content
    that most files have is no single task.
    """
    return hot.joined(files, files.groupBy("size", "sha256").agg(*counts).filter(kept), ["size", "sha256"], "copies", ["scan_id", "entry_id"])


def report(inv: Inventory, name: str, allow_partial: bool = False) -> DataFrame:
    """Every copy of each content that a scan holds more than once, largest first."""
    own = scan(inv, name)
    if own["phase"] not in DONE and not allow_partial:
        raise Refused(f"{name!r} is not finished", "INVALID_INVENTORY")
    mine = F.col("scan_id") == own["scan_id"]
    files = inv.entries.filter(mine & (F.col("kind") == "FILE")).join(inv.hashes.filter(mine), ["scan_id", "entry_id"])
    return with_counts(files, [F.count("*").alias("copies")], F.col("copies") > 1).select(
        "size", "sha256", "copies", "entry_id", "relative_path", paths.joined(F.lit(own["root"]), F.col("relative_path")).alias("path"), F.lit(own["phase"] not in DONE).alias("partial")
    ).orderBy(F.desc("size"), "sha256", "relative_path")


def status(inv: Inventory, name: str) -> DataFrame:
    """One row of counts of a scan."""
    own = scan(inv, name)
    mine = F.col("scan_id") == own["scan_id"]
    entries = inv.entries.filter(mine)
    file = F.col("kind") == "FILE"
    counts = entries.agg(
        F.count_if(file).alias("files"), F.count_if(F.col("kind") == "DIRECTORY").alias("directories"), F.count_if(F.col("kind") == "SYMLINK").alias("symlinks"),
        F.count_if(F.col("kind") == "OTHER").alias("others"), P.total(F.when(file, F.col("size"))).alias("file_bytes"),
    )
    sizes = entries.filter(file).groupBy("size").count().filter("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("candidate_files"))
    out = counts
    for one in (
        inv.hashes.filter(mine).agg(F.count("*").alias("hashes")), inv.directories.filter(mine).agg(F.count_if(~F.col("completed")).alias("pending_directories")),
        inv.scan_errors.filter(mine).agg(F.count("*").alias("errors")), sizes,
    ):
        out = out.crossJoin(one)  # one row each
    return out.select(F.lit(own["scan_id"]).cast("long").alias("scan_id"), F.lit(name).alias("name"), F.lit(own["phase"]).alias("phase"), *out.columns)


def cross_groups(inv: Inventory, names: list[str]) -> DataFrame:
    """Contents that two or more of the named scans hold."""
    chosen = candidates.selected(inv, names)
    if inv.contents is not None:
        found = contents.copies(inv.contents.join(F.broadcast(chosen), "scan_id", "left_semi"))
        return found.withColumnRenamed("scan_copies", "scan_count").filter("scan_count >= 2")
    files = candidates.cross_candidates(inv, chosen).filter("sha256 is not null")
    return files.groupBy("size", "sha256").agg(F.count("*").alias("copies"), F.count_distinct("scan_id").alias("scan_count")).filter("scan_count >= 2")


def cross_report(inv: Inventory, names: list[str]) -> DataFrame:
    """Every copy of such contents, largest first, scans in the order asked for."""
    chosen = candidates.selected(inv, names)
    files = candidates.cross_candidates(inv, chosen).filter("sha256 is not null")
    kept = with_counts(files, [F.count("*").alias("copies"), F.size(F.collect_set("scan_id")).cast("long").alias("scan_count")], F.col("scan_count") >= 2)  # a set is at most the named scans
    named = kept.join(F.broadcast(inv.scans.select("scan_id", "name", "root")), "scan_id")
    return named.select("size", "sha256", "copies", "scan_count", "scan_ordinal", F.col("name").alias("scan_name"), "entry_id", "relative_path", paths.joined(F.col("root"), F.col("relative_path")).alias("path")).orderBy(
        F.desc("size"), "sha256", "scan_ordinal", "relative_path", "entry_id"
    )


def cross_summary(inv: Inventory, names: list[str]) -> dict:
    chosen = candidates.selected(inv, names)
    counts = candidates.cross_counters(inv, chosen).first().asDict()
    sizes = candidates.cross_sizes(inv, chosen).count()
    errors = inv.scan_errors.join(F.broadcast(chosen), "scan_id", "left_semi").groupBy("phase").count().collect()
    by = {r["phase"]: r["count"] for r in errors}
    partial = counts["pending_files"] > 0 or bool(by)
    return counts | {
        "candidate_sizes": sizes, "discovery_errors": by.get("DISCOVERY", 0), "hash_errors": by.get("HASHING", 0), "partial": partial, "phase": "COMPLETE_WITH_ERRORS" if partial else "COMPLETE",
        "warnings": [f"{counts['pending_files']} candidates have no digest"] * (counts["pending_files"] > 0),
    }


def _anchored(inv: Inventory, wanted: dict) -> Column:
    """Restricts files to the content of a reference file before anything is grouped."""
    at = wanted["reference"]
    if not at:
        return F.lit(True)
    own = (F.col("scan_id") == at["scan_id"]) & (F.col("entry_id") == at["entry_id"])
    found = inv.entries.filter(own & (F.col("kind") == "FILE")).join(inv.hashes, ["scan_id", "entry_id"], "left").select("size", "sha256").limit(1).collect()
    if not found:
        raise Refused("no such file", "ENTRY_NOT_FOUND")
    if found[0]["sha256"] is None:
        raise Refused("the file has no digest", "HASH_UNAVAILABLE")
    return (F.col("size") == found[0]["size"]) & (F.col("sha256") == found[0]["sha256"])


def flagged(inv: Inventory, request: dict) -> DataFrame:
    """Hashed files of the selected scans; the request's filters are a column, so that they choose groups and not members."""
    wanted = spec.group_search(request)
    seen = P.observations(inv, wanted["scan_ids"]).filter("kind = 'FILE' and sha256 is not null").filter(_anchored(inv, wanted))
    return seen.withColumn("filter_match", F.coalesce(P.content(inv, wanted), F.lit(False)))


def observed() -> Column:
    return (F.col("size").cast("decimal(19,0)") * F.col("occurrences").cast("decimal(18,0)")).cast(P.HUGE)


def groups(inv: Inventory, request: dict) -> DataFrame:
    """Every group that qualifies, with counts over all its members in the selected scans."""
    wanted = spec.group_search(request)
    facts = flagged(inv, request).groupBy("size", "sha256").agg(
        F.count("*").alias("occurrences"), F.count_distinct("scan_id").alias("scan_count"), F.count_if("filter_match").alias("matching_occurrences"),
        F.count_if("has_error").alias("error_occurrences"), F.min("relative_path").alias("sample_path"),
    )
    kept = facts.filter((F.col("occurrences") >= wanted["min_occurrences"]) & (F.col("scan_count") >= wanted["min_scans"]) & (F.col("matching_occurrences") > 0))
    return kept.withColumn("observed_bytes", observed()).withColumn("group_id", F.concat_ws(":", F.col("size").cast("string"), "sha256"))


def group_keys(wanted: dict) -> list[tuple[Column, bool]]:
    first = {"SIZE": F.col("size"), "OCCURRENCES": F.col("occurrences"), "SCANS": F.col("scan_count"), "OBSERVED_BYTES": F.col("observed_bytes")}[wanted["sort"]]
    return [(first, wanted["descending"]), (F.col("size"), wanted["descending"]), (F.col("sha256"), wanted["descending"])]


def group_page(inv: Inventory, request: dict, position: list | None = None) -> DataFrame:
    """A page of groups; with kept counts it is cut from them, and facts are gathered for its contents alone, unless files are filtered."""
    wanted = spec.group_search(request)
    plain = not wanted["reference"] and all(wanted[k] == v for k, v in spec.file_filter({}).items())
    if inv.contents is not None and plain:
        counts = contents.copies(inv.contents, wanted["scan_ids"]).withColumnsRenamed({"copies": "occurrences", "scan_copies": "scan_count"})
        kept = counts.filter((F.col("occurrences") >= wanted["min_occurrences"]) & (F.col("scan_count") >= wanted["min_scans"]))
        cut = settle(cursor.page(kept.withColumn("observed_bytes", observed()), group_keys(wanted), wanted["limit"], position))
        sizes, own = F.broadcast(cut.select("size").distinct()), F.broadcast(cut.select("size", "sha256"))  # a page's, at most 501
        files = inv.entries.join(sizes, "size", "left_semi")
        same = P.scoped(files, wanted["scan_ids"]).join(P.scoped(inv.hashes, wanted["scan_ids"]), ["scan_id", "entry_id"]).join(own, ["size", "sha256"], "left_semi")
        inv = inv.with_tables(entries=files, hashes=same.select(*SCHEMAS["hashes"].names))
    return cursor.page(groups(inv, request), group_keys(wanted), wanted["limit"], position).withColumn("observed_bytes", F.col("observed_bytes").cast("string"))


def group_summary(inv: Inventory, request: dict) -> DataFrame:
    return groups(inv, request).agg(F.count("*").alias("groups"), P.total(F.col("occurrences")).alias("occurrences"), P.total(F.col("observed_bytes")).alias("observed_bytes"))


def coverage(inv: Inventory, scan_ids: list[int]) -> DataFrame:
    """How much of the selected scans the groups can speak for."""
    ids = spec.scan_ids(scan_ids, needed=True)
    files = P.observations(inv, ids).filter("kind = 'FILE'").agg(
        F.count("*").alias("files"), F.count("sha256").alias("hashed_files"), F.count_if(F.col("sha256").isNull()).alias("unhashed_files"), F.count_if("has_error").alias("files_with_errors")
    )
    unfinished = P.scoped(inv.scans, ids).agg(F.count_if(~F.col("phase").isin(*DONE)).alias("incomplete_scans"))
    errors = P.scoped(inv.scan_errors, ids).agg(F.count("*").alias("errors"))
    return files.crossJoin(unfinished).crossJoin(errors)  # one row each


def occurrences(inv: Inventory, group_id: str, request: dict, position: list | None = None) -> DataFrame:
    """A page of all members of one group, each with whether it matches the filters."""
    wanted = spec.group_search(request)
    try:
        size, digest = group_id.split(":")
        own = (F.col("size") == int(size)) & (F.col("sha256") == digest)
    except ValueError as e:
        raise InvalidFilter("no group has this id") from e
    rows = flagged(inv, request).filter(own).join(F.broadcast(inv.scans.select("scan_id", "name", "root")), "scan_id")
    shown = rows.select("scan_id", F.col("name").alias("scan_name"), "entry_id", "relative_path", paths.joined(F.col("root"), F.col("relative_path")).alias("path"), "has_error", F.col("filter_match").alias("matches_filters"))
    return cursor.page(shown, [(F.col(c), False) for c in ("scan_id", "relative_path", "entry_id")], wanted["limit"], position)

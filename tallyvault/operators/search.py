"""File search: predicates over entries, copies counted within the selected scans, keyset pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvault import cursor, spec
from tallyvault.functions import paths
from tallyvault.inventory import Inventory
from tallyvault.operators import contents, hot
from tallyvault.operators import predicates as P
from tallyvault.storage import settle


def sort_key(kind: str) -> Column:
    return {
        "PATH": F.lower("relative_path"), "NAME": F.lower("filename"), "SCAN": F.lower("name"), "SIZE": F.col("size").cast(P.HUGE),
        "MODIFIED": F.col("modified_sec").cast(P.HUGE) * F.lit(1_000_000_000).cast("decimal(11,0)") + F.col("modified_nano"),
    }[kind]


def _found(inv: Inventory, seen: DataFrame, wanted: dict, whole: Inventory | None = None) -> DataFrame:
    """The observations that a request finds, named, with the key they are sorted by."""
    found = seen.filter(P.content(whole or inv, wanted, wanted["duplicate_state"])).join(F.broadcast(inv.scans.select("scan_id", "name", "root")), "scan_id")
    return found.withColumn("sort_key", sort_key(wanted["sort"]))


def _shown(found: DataFrame) -> DataFrame:
    return found.select(
        "scan_id", "entry_id", F.col("name").alias("scan_name"), "filename", "relative_path", paths.joined(F.col("root"), F.col("relative_path")).alias("path"), "kind", "size", "modified_sec", "modified_nano", "sha256",
        F.when(F.col("sha256").isNull(), "UNHASHED").otherwise("HASHED").alias("hash_state"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("scan_copies", F.lit(0)).alias("scan_copies"), "has_error", "sort_key",
    )


def matching(inv: Inventory, request: dict) -> DataFrame:
    """Every file that a request finds, with its scan, its copies and the key it is sorted by."""
    wanted = spec.file_search(request)
    seen = P.observations(inv, wanted["scan_ids"])
    counted = hot.joined(seen, P.copies(seen), ["size", "sha256"], "copies", ["scan_id", "entry_id"], keep=True)
    return _shown(_found(inv, counted, wanted))


def keys(falling: bool) -> list[tuple[Column, bool]]:
    return [(F.col("sort_key"), falling), (F.col("scan_id"), falling), (F.col("entry_id"), falling)]


def page(inv: Inventory, request: dict, position: list | None = None) -> DataFrame:
    """One page and one row more.

    Unless the request asks for copies, they are counted after the page is cut, for its contents alone.
    """
    wanted = spec.file_search(request)
    if wanted["duplicate_state"] not in (None, "ANY"):
        return cursor.page(matching(inv, request), keys(wanted["descending"]), wanted["limit"], position)
    return finished(inv, first(inv, wanted, position), wanted)


def first(inv: Inventory, wanted: dict, position: list | None, whole: Inventory | None = None) -> DataFrame:
    """A page's rows without their copies; `whole` is where a directory is looked up, if the files that are searched are fewer."""
    found = _found(inv, P.observations(inv, wanted["scan_ids"]), wanted, whole or inv)
    return settle(cursor.page(found, keys(wanted["descending"]), wanted["limit"], position))


def finished(inv: Inventory, rows: DataFrame, wanted: dict) -> DataFrame:
    """A page with its copies, which are kept counts or counted for its contents alone."""
    own = F.broadcast(rows.select("size", "sha256").filter("sha256 is not null").distinct())  # a page's, at most 501
    sizes = F.broadcast(rows.select("size").distinct())
    if inv.contents is not None:
        counts = contents.copies(inv.contents.join(sizes, "size", "left_semi").join(own, ["size", "sha256"], "left_semi"), wanted["scan_ids"])
    else:
        files = P.scoped(inv.entries, wanted["scan_ids"]).filter("kind = 'FILE'").join(sizes, "size", "left_semi")
        counts = P.copies(files.join(P.scoped(inv.hashes, wanted["scan_ids"]), ["scan_id", "entry_id"]).join(own, ["size", "sha256"], "left_semi"))
    return cursor.page(_shown(rows.join(counts, ["size", "sha256"], "left")), keys(wanted["descending"]), wanted["limit"])


def search(inv: Inventory, request: dict) -> dict:
    """Rows, the next cursor, and whether the selected scans (not the matches) hold unhashed files."""
    wanted = spec.file_search(request)
    rows, more = cursor.cut(page(inv, request, cursor.decode(wanted, request.get("cursor"))).collect(), wanted["limit"])
    scope = P.observations(inv, wanted["scan_ids"], errors=False).filter("kind = 'FILE' and sha256 is null")
    last = rows[-1] if rows else None
    return {
        "items": [r.asDict() for r in rows],
        "next_cursor": cursor.encode(wanted, [last["sort_key"], last["scan_id"], last["entry_id"]]) if more else None,
        "coverage": {"has_unhashed_files": not scope.isEmpty()},
    }

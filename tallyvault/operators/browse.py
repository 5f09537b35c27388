"""Looking around in an inventory: scans, entries, children, ancestors, errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvault import cursor, spec
from tallyvault.errors import InvalidFilter, Refused
from tallyvault.functions import paths
from tallyvault.inventory import Inventory
from tallyvault.operators import contents
from tallyvault.operators import predicates as P

MOST_OFFSET = 1_000_000
MOST_DEPTH = 1024
MOST_SCAN_NAME = 256
RELATED_ERRORS = 20


def dashboard(inv: Inventory) -> DataFrame:
    """One row of counts over all scans."""
    file = F.col("kind") == "FILE"
    entries = inv.entries.agg(F.count_if(file).alias("files"), F.count_if(F.col("kind") == "DIRECTORY").alias("directories"), P.total(F.when(file, F.col("size"))).alias("file_bytes"))
    # over every stored digest, whatever algorithm its scan names
    copies = contents.copies(inv.contents) if inv.contents is not None else inv.entries.join(inv.hashes, ["scan_id", "entry_id"]).groupBy("size", "sha256").agg(F.count("*").alias("copies"))
    groups = copies.filter("copies > 1").agg(F.count("*").alias("duplicate_groups"))
    out = inv.scans.agg(F.count("*").alias("scans"))
    for one in (entries, inv.hashes.agg(F.count("*").alias("hashes")), inv.scan_errors.agg(F.count("*").alias("errors")), groups):
        out = out.crossJoin(one)  # one row each
    return out


def summaries(inv: Inventory) -> DataFrame:
    """A row of counts for each scan."""
    file = F.col("kind") == "FILE"
    entries = inv.entries.groupBy("scan_id").agg(
        F.count_if(file).alias("files"), F.count_if(F.col("kind") == "DIRECTORY").alias("directories"), P.total(F.when(file, F.col("size"))).alias("file_bytes")
    )
    hashes = inv.hashes.groupBy("scan_id").agg(F.count("*").alias("hashes"))
    errors = inv.scan_errors.groupBy("scan_id").agg(F.count("*").alias("errors"))
    out = inv.scans.select("scan_id", "name", "phase")
    for one in (entries, hashes, errors):
        out = out.join(F.broadcast(one), "scan_id", "left")  # a row a scan
    return out.fillna(0, ["files", "directories", "hashes", "errors"]).fillna("0", ["file_bytes"])


def scans(inv: Inventory, name: str | None = None, phase: str | None = None, has_errors: bool | None = None, after: int = 0, limit: int | None = None) -> DataFrame:
    """A page of scans by id."""
    if name is not None and len(name) > MOST_SCAN_NAME:
        raise InvalidFilter(f"a scan's name has at most {MOST_SCAN_NAME} characters")
    found = inv.scans
    if name:
        found = found.filter(F.lower("name").contains(F.lower(F.lit(name))))
    if phase:
        found = found.filter(F.col("phase") == phase)
    if has_errors is not None:
        found = found.join(inv.scan_errors, "scan_id", "left_semi" if has_errors else "left_anti")
    return cursor.page(found.select("scan_id", "name", "root", "phase"), [(F.col("scan_id"), False)], spec.page_size(limit), [after])


def entry(inv: Inventory, scan_id: int, entry_id: int) -> DataFrame:
    """One entry with its path, its digest and how many files of all scans are its copies."""
    own = (F.col("scan_id") == scan_id) & (F.col("entry_id") == entry_id)
    found = inv.entries.filter(own).join(inv.hashes, ["scan_id", "entry_id"], "left").join(F.broadcast(inv.scans.select("scan_id", "name", "root", "algorithm")), "scan_id")
    files = inv.entries.filter("kind = 'FILE'").join(inv.hashes, ["scan_id", "entry_id"]).join(F.broadcast(inv.scans.filter("algorithm = 'SHA-256'")), "scan_id", "left_semi")
    # only files of the entry's content are counted
    same = files.join(F.broadcast(found.filter("algorithm = 'SHA-256'").select("size", "sha256")), ["size", "sha256"], "left_semi")
    return found.join(F.broadcast(P.copies(same)), ["size", "sha256"], "left").select(
        "scan_id", "entry_id", "parent_id", "filename", "kind", "relative_path", paths.joined(F.col("root"), F.col("relative_path")).alias("path"), "size", "sha256",
        F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("scan_copies", F.lit(0)).alias("scan_copies"),
    )


def related_errors(inv: Inventory, scan_id: int, relative_path: str) -> DataFrame:
    own = inv.scan_errors.filter((F.col("scan_id") == scan_id) & (F.col("relative_path") == relative_path))
    return own.orderBy(F.desc("recorded_at_ms")).limit(RELATED_ERRORS)


def children(inv: Inventory, scan_id: int, parent_id: int, limit: int | None = None, position: list | None = None) -> DataFrame:
    """A page of a directory: directories first, then by name; with copies over all scans."""
    own = inv.entries.filter((F.col("scan_id") == scan_id) & (F.col("parent_id") == parent_id))
    rank = F.when(F.col("kind") == "DIRECTORY", 0).otherwise(1)
    ranked = own.select("scan_id", "entry_id", "filename", "kind", "relative_path", "size", rank.alias("rank"))
    shown = cursor.page(ranked, [(F.col(c), False) for c in ("rank", "filename", "entry_id")], spec.page_size(limit), position)
    with_digest = shown.join(inv.hashes.filter(F.col("scan_id") == scan_id), ["scan_id", "entry_id"], "left")
    good = F.broadcast(inv.scans.filter("algorithm = 'SHA-256'"))
    # a page has at most 501 contents
    files = inv.entries.filter("kind = 'FILE'").join(F.broadcast(shown.select("size").distinct()), "size", "left_semi").join(inv.hashes, ["scan_id", "entry_id"]).join(good, "scan_id", "left_semi")
    return with_digest.join(P.copies(files), ["size", "sha256"], "left").select("scan_id", "entry_id", "filename", "kind", "relative_path", "size", "rank", "sha256", F.coalesce("copies", F.lit(0)).alias("copies"))


def breadcrumbs(inv: Inventory, scan_id: int, entry_id: int) -> DataFrame:
    """An entry's ancestors from the root to itself, one row each, by the prefixes of its path."""
    own = inv.entries.filter((F.col("scan_id") == scan_id) & (F.col("entry_id") == entry_id)).select("relative_path").limit(1).collect()
    if not own:
        raise Refused("no such entry", "ENTRY_NOT_FOUND")
    parts = own[0][0].split("/") if own[0][0] else []
    if len(parts) > MOST_DEPTH:
        raise Refused("the entry is nested too deep", "INVALID_INVENTORY")
    chain = ["", *("/".join(parts[: i + 1]) for i in range(len(parts)))]
    found = inv.entries.filter((F.col("scan_id") == scan_id) & F.col("relative_path").isin(chain))
    shown = found.select("scan_id", "entry_id", "parent_id", "filename", "relative_path", F.when(F.col("relative_path") == "", 0).otherwise(paths.depth(F.col("relative_path")) + 1).alias("level"))
    rows = shown.orderBy("level").collect()  # at most MOST_DEPTH
    # each is its predecessor's child: a path that turns back or is stored twice is refused
    if [r["relative_path"] for r in rows] != chain or any(b["parent_id"] != a["entry_id"] for a, b in zip(rows, rows[1:], strict=False)):
        raise Refused("the entry's ancestors do not lead to the root", "INVALID_INVENTORY")
    return inv.spark.createDataFrame(rows, shown.schema)


def errors(inv: Inventory, scan_id: int, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page of a scan's errors, the latest first."""
    if not 0 <= offset <= MOST_OFFSET:
        raise InvalidFilter(f"an offset is at most {MOST_OFFSET}")
    own = inv.scan_errors.filter(F.col("scan_id") == scan_id)
    return own.orderBy(F.desc("recorded_at_ms"), "phase", "relative_path", "message").offset(offset).limit(spec.page_size(limit) + 1)


def all_errors(inv: Inventory, scan_id: int) -> DataFrame:
    return inv.scan_errors.filter(F.col("scan_id") == scan_id).orderBy("recorded_at_ms", "relative_path")

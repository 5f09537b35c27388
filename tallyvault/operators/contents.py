"""Counts of files by scan, size and digest that a store keeps, so that copies need no count of the files.

Counts are sums, so a batch of digests adds its own as rows of its own (streaming/ingest.py)
and a reader sums what it finds.  The store drops a scan's counts when a save changes the
scan's files or digests without them; such a scan is counted from its files until
`refreshed` keeps its counts again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvault.inventory import Inventory, Store
from tallyvault.operators.predicates import scoped

KEY = ["scan_id", "size", "sha256"]


def counted(files: DataFrame) -> DataFrame:
    """Counts of hashed files (kind, size and sha256 given)."""
    return files.filter("kind = 'FILE' and sha256 is not null").groupBy(*KEY).agg(F.count("*").alias("files"))


def of_scans(inv: Inventory, scan_ids: list[int]) -> DataFrame:
    return counted(scoped(inv.entries, scan_ids).join(scoped(inv.hashes, scan_ids), ["scan_id", "entry_id"]))


def missing(store: Store, revision: int | None = None) -> list[int]:
    """Scans with digests whose counts are not kept."""
    live = store.manifest(revision)["tables"]
    return sorted(int(s) for s in live.get("hashes", {}) if s not in live.get("contents", {}))


def loaded(store: Store) -> Inventory:
    """The store's inventory with its counts: those that are kept, and those of the other scans from their files."""
    inv = store.load()
    kept, rest = store.stored("contents", inv.revision), missing(store, inv.revision)
    inv.contents = kept.unionByName(of_scans(inv, rest)) if rest else kept
    return inv


def refreshed(store: Store, *scan_ids: int) -> int:
    """Keep the counts of scans from now on, or of all that lack them; a scan's many small additions become one.

    Rows are sorted by size, so that the contents of a page are found in few row groups.
    """
    inv = store.load()
    chosen = sorted(scan_ids) or missing(store, inv.revision)
    known = set(missing(store, inv.revision))
    summed = store.stored("contents", inv.revision).filter(F.col("scan_id").isin([s for s in chosen if s not in known]))
    new = summed.groupBy(*KEY).agg(F.sum("files").alias("files"))
    if counting := [s for s in chosen if s in known]:
        new = new.unionByName(of_scans(inv, counting))
    generation = uuid.uuid4().hex
    written = store.write("contents", new.repartitionByRange(*KEY).sortWithinPartitions(*KEY), generation)
    return store.publish([("contents", str(s), False) for s in chosen], {"contents": written}, generation, inv.revision)


def copies(counts: DataFrame, scan_ids: list[int] | None = None) -> DataFrame:
    """copies and scan_copies of each content, as `predicates.copies` counts them from files."""
    return scoped(counts, scan_ids or []).groupBy("size", "sha256").agg(F.sum("files").alias("copies"), F.count_distinct("scan_id").alias("scan_copies"))

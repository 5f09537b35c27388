"""The walk of a scan's tree in rounds, each of which is published before the next begins.

Between rounds the store has everything that was found so far and the frontier: the
directories that are known and not listed yet.  A round lists some of the frontier, and what
is below as far as its tasks get, adds what it found to what was there, and replaces the
frontier alone.  So a walk that is killed loses one round, and is resumed from its frontier.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tallyvault.errors import Refused
from tallyvault.inventory import Inventory, Store, scan
from tallyvault.operators import candidates
from tallyvault.schemas import BASE, SCHEMAS
from tallyvault.sources import filesystem
from tallyvault.storage import settle

#: Directories of the frontier that one round is given.
MOST_DIRECTORIES = 50_000
#: Entries after which a task of a round lists no further directory.
TASK_ENTRIES = 100_000


def loaded(store: Store) -> Inventory:
    """With all base tables, empty if need be."""
    found = store.load()
    return found.with_tables(**{t: getattr(found, t) for t in BASE})


def _head(store: Store, own: dict):
    own["updated_at"] = datetime.now(timezone.utc)
    return store.spark.createDataFrame([tuple(own[c] for c in SCHEMAS["scans"].names)], SCHEMAS["scans"])


def begun(store: Store, name: str, root: str) -> int:
    """Publish a new scan with nothing but its root, which is its frontier."""
    inv = loaded(store)
    if not name.strip() or len(name) > 200 or not inv.scans.filter(F.col("name") == name).isEmpty():
        raise Refused("a scan needs a new name of 1 to 200 characters")
    id_, now = inv.scans.agg(F.coalesce(F.max("scan_id"), F.lit(0)) + 1).first()[0], datetime.now(timezone.utc)
    root = root.rstrip("/") or "/"
    found = filesystem.top(root)
    head = _head(store, {"scan_id": id_, "name": name, "root": root, "phase": "DISCOVERING", "algorithm": "SHA-256", "active_dir": None, "next_entry_id": 2, "created_at": now})
    entry = store.spark.createDataFrame([(id_, 1, 0, *found)], SCHEMAS["entries"])
    store.save(append=True, scans=head, entries=entry, frontier=store.spark.createDataFrame([(id_, 1, 0, "", False)], SCHEMAS["directories"]))
    return id_


def walked(store: Store, name: str, rounds: int | None = None) -> None:
    """Walk a scan's frontier round by round to its end, or so many rounds."""
    while rounds is None or rounds > 0:
        inv = store.load()
        own = scan(inv, name)
        id_ = own["scan_id"]
        if own["phase"] != "DISCOVERING":
            return
        frontier = store.stored("frontier").filter(F.col("scan_id") == id_)
        starts = settle(frontier.orderBy("entry_id").limit(MOST_DIRECTORIES))
        if starts.isEmpty():
            store.save(scan=id_, base=inv.revision, scans=_head(store, own | {"phase": "READY"}))
            return
        entries, errors, listed = filesystem.round_of(store.spark, own["root"], id_, starts, own["next_entry_id"], TASK_ENTRIES, [store.folder])
        folders = entries.filter("kind = 'DIRECTORY'").select("scan_id", "entry_id", "parent_id", "relative_path", (~F.col("open")).alias("completed"))
        done = starts.join(listed, "relative_path", "left_semi").withColumn("completed", F.lit(True))
        # a round's paths, MOST_DIRECTORIES at most
        left = frontier.join(F.broadcast(done.select("entry_id")), "entry_id", "left_anti").select(*SCHEMAS["directories"].names)
        last = entries.agg(F.max("entry_id")).first()[0]
        head = _head(store, own | {"next_entry_id": max(own["next_entry_id"], (last or 0) + 1)})
        store.save(
            scan=id_, append=("entries", "directories", "scan_errors"), base=inv.revision, scans=head, entries=entries.drop("open"), scan_errors=errors,
            directories=done.select(*SCHEMAS["directories"].names).unionByName(folders.filter("completed")), frontier=left.unionByName(folders.filter("not completed")),
        )
        rounds = None if rounds is None else rounds - 1


def resumed(store: Store, name: str) -> None:
    """Go on with a discovery that was interrupted, here or in the inventory that a scan came from; else nothing.

    Open directories that stand among the others, as an inventory from elsewhere has them,
    become the frontier once; what they and the active directory had recorded in part is dropped.
    """
    inv = loaded(store)
    own = scan(inv, name)
    id_ = own["scan_id"]
    mine = F.col("scan_id") == id_
    stray = store.stored("directories").filter(mine & ~F.col("completed"))
    if own["active_dir"] is not None or not stray.isEmpty():
        open_ = candidates.unfinished_directories(inv, id_, None)
        parents = settle(open_.select(F.col("entry_id").alias("parent_id")))
        kept = candidates.without_partial_walk(inv, id_).filter(mine).join(parents, "parent_id", "left_anti")
        done = inv.directories.filter(mine & F.col("completed")).join(parents, "parent_id", "left_anti")
        frontier = open_.withColumn("completed", F.lit(False))
        store.save(
            scan=id_, base=inv.revision, scans=_head(store, own | {"active_dir": None, "phase": "DISCOVERING"}), entries=settle(kept.select(*SCHEMAS["entries"].names)),
            directories=settle(done.select(*SCHEMAS["directories"].names)), frontier=settle(frontier.select(*SCHEMAS["directories"].names)),
        )
    walked(store, name)

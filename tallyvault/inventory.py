"""An inventory: named tables, and their immutable generations on storage.

A save writes what changed into new generation folders and then adds one small manifest,
numbered and created exclusively, that names the live generations.  Readers follow the last
manifest, so an unfinished save is invisible and the one before it stays whole.  Of two
saves at once one gets the number; the other looks at what has been saved since it read,
and goes on after it, or is refused if both touch the same scan of a table.

Tables with a scan_id are stored by scan, and the manifest names the generations of each
scan of a table: a new scan, or new digests of one, write that scan alone, and a filter
on scan_id reads only its folders.  Other tables are lists of generations.

A store may keep more than an inventory has: the frontier of walks, counts of contents
(operators/contents.py), and the zones and grams of files (layout.py).
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvault.errors import InvalidInventory, Refused
from tallyvault.schemas import BASE, SCHEMAS, STORED, VERSION, conforming


#: Manifests that are kept; a save that has read an older one is refused.
KEPT = 1_000
#: Attempts to get the next number.
ATTEMPTS = 100


def by_scan(table: str) -> bool:
    return "scan_id" in STORED[table].names


@dataclass
class Inventory:
    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    #: of the store that the tables were loaded from
    revision: int | None = None
    #: files by scan and content, if they are known without a count of the files
    contents: DataFrame | None = None

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SCHEMAS:
            raise AttributeError(name)
        if name not in self.tables:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.tables[name]

    def with_tables(self, **tables: DataFrame) -> Inventory:
        return Inventory(self.spark, self.tables | tables, self.revision)

    def features(self) -> set[str]:
        return {"base"} | {f for f in ("archive", "image") if f"{f}_runs" in self.tables}


class Store:
    """A folder that Spark and its Hadoop file system can write, local or shared."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def revision(self) -> int:
        """The number of the last manifest."""
        log = self._path(f"{self.folder}/_manifests")
        found = self._fs.listStatus(log) if self._fs.exists(log) else []
        return max((int(n.removesuffix(".json")) for n in (str(f.getPath().getName()) for f in found) if n.endswith(".json") and not n.startswith(".")), default=0)

    def _log(self, revision: int) -> str:
        return f"{self.folder}/_manifests/{revision:020d}.json"

    def manifest(self, revision: int | None = None) -> dict:
        """The last manifest, or an earlier one that is still kept."""
        number = self.revision() if revision is None else revision
        if number == 0:
            return {"version": VERSION, "revision": 0, "tables": {}, "touched": []}
        path = self._path(self._log(number))
        if not self._fs.exists(path):
            raise Refused("the store has changed too often meanwhile", "SCENARIO_REVISION_CONFLICT")
        stream = self._fs.open(path)
        try:
            text = bytes(b & 255 for b in stream.readAllBytes()).decode()
        finally:
            stream.close()
        found = json.loads(text)
        if found.get("version") != VERSION:
            raise Refused(f"version {found.get('version')} is not {VERSION}", "UNSUPPORTED_SCHEMA")
        return found

    def _read(self, name: str, live: list | dict) -> DataFrame:
        if isinstance(live, list):
            return self.spark.read.schema(STORED[name]).parquet(*[f"{self.folder}/{name}/generation={g}" for g in live])
        folders = [f"{self.folder}/{name}/generation={g}/scan_id={scan_}" for scan_, generations in live.items() for g in generations]
        if not folders:
            return self.spark.createDataFrame([], STORED[name])
        # the folders' names give scan_id, so that filters on it choose folders
        return self.spark.read.schema(STORED[name]).option("basePath", f"{self.folder}/{name}").parquet(*folders).select(*STORED[name].names)

    def load(self) -> Inventory:
        """The tables of the last manifest, and its number; directories that are not listed yet are among the others."""
        found = self.manifest()
        tables = {name: conforming(self._read(name, live), name) for name, live in found["tables"].items()}
        tables = {name: df for name, df in tables.items() if name in SCHEMAS or name == "frontier"}
        open_ = tables.pop("frontier", None)
        if open_ is not None and found["tables"]["frontier"]:
            tables["directories"] = tables["directories"].unionByName(open_) if "directories" in tables else open_
        return Inventory(self.spark, tables, found["revision"])

    def stored(self, name: str, revision: int | None = None) -> DataFrame:
        """One table as it is stored, by the last manifest or an earlier one."""
        live = self.manifest(revision)["tables"].get(name)
        return conforming(self._read(name, live), name) if live else self.spark.createDataFrame([], STORED[name])

    def files(self, name: str, chosen: list[tuple[str, str, str]], told: str | None = None) -> DataFrame:
        """Rows of a table by scan from some of its files alone, each given as scan, generation and name (an empty name: all of the
        generation); with a column `file` of what Spark tells of files, if wanted."""
        places = [f"{self.folder}/{name}/generation={g}/scan_id={s}{'/' + f if f else ''}" for s, g, f in chosen]
        more = [] if told is None else [F.col(told).alias("file")]
        if not chosen:
            return self.spark.createDataFrame([], STORED[name]).select("*", *[F.lit("").alias("file") for _ in more])
        return self.spark.read.schema(STORED[name]).option("basePath", f"{self.folder}/{name}").parquet(*places).select(*STORED[name].names, *more)

    def write(self, name: str, df: DataFrame, generation: str) -> list[str]:
        """Write rows as a generation that no manifest names yet; of a table by scan, the scans that it has."""
        path = f"{self.folder}/{name}/generation={generation}"
        rows = conforming(df, name)
        if not by_scan(name):
            rows.write.mode("errorifexists").parquet(path)
            return []
        rows.write.partitionBy("scan_id").mode("errorifexists").parquet(path)
        found = self._fs.listStatus(self._path(path))
        return sorted((n.removeprefix("scan_id=") for n in (str(f.getPath().getName()) for f in found) if n.startswith("scan_id=")), key=lambda n: (len(n), n))

    def save(self, revision: int | None = None, scan: int | None = None, append: bool | tuple[str, ...] = False, base: int | None = None, **tables: DataFrame) -> int:
        """Publish new generations; the number they got.

        A table is replaced as a whole, unless `append` (for all tables, or those named) adds
        the rows to those there are, or `scan` replaces what it has of that scan alone.  Only
        tables by scan know the latter.

        With `revision` nothing may have been saved since that manifest.  With `base`, the
        manifest whose tables the caller has read, nothing that this save touches may have
        been.  With neither, what is replaced must not be saved by others while this save
        writes; rows that are appended join whatever there is by then.
        """
        before = self.manifest()["revision"]
        since = before if base is None else base
        if revision is not None and revision != before:
            raise Refused("the store has changed meanwhile", "SCENARIO_REVISION_CONFLICT")
        generation, changes = uuid.uuid4().hex, []  # changes: table, scan or none, whether rows are added
        for name, df in tables.items():
            added = name in append if isinstance(append, tuple) else append
            if not by_scan(name):
                if scan is not None and not added:
                    raise Refused(f"{name} is not stored by scan", "UNSUPPORTED_SCHEMA")
                self.write(name, df, generation)
                changes.append((name, None, added))
                continue
            only = scan if not added else None
            new = self.write(name, df if only is None else df.filter(df.scan_id == only), generation)
            if added:
                changes += [(name, s, True) for s in new]
            else:
                changes.append((name, None if only is None else str(only), False))
                tables = tables | {name: new}  # the scans it has now
        return self.publish(changes, tables, generation, since, revision, base is not None)

    def publish(self, changes: list, tables: dict, generation: str, since: int, revision: int | None = None, read: bool = True, same: bool = False) -> int:
        """Name a generation that has been written in the next manifest; the number that this gets.

        `changes` tells what it replaces or adds to as (table, scan or None, whether rows are
        added), `tables` the scans that each replaced table by scan has now, and `same` that
        the tables' rows are those they had.
        """
        for _ in range(ATTEMPTS):
            live = self.manifest()
            if revision is not None and revision != live["revision"]:
                raise Refused("the store has changed meanwhile", "SCENARIO_REVISION_CONFLICT")
            self._compatible(changes, since, live, read)
            after = {"version": VERSION, "revision": live["revision"] + 1, "tables": self._after(live["tables"], changes, tables, generation, same), "touched": changes}
            if self._create(after["revision"], json.dumps(after, sort_keys=True)):
                self._fs.delete(self._path(self._log(after["revision"] - KEPT)), False)
                return after["revision"]
        raise Refused("others save all the time", "SCENARIO_REVISION_CONFLICT")

    def _compatible(self, changes: list, since: int, live: dict, read: bool) -> None:
        """Refuse changes that touch what others have saved since; rows that both only add are compatible unless the caller has read first."""
        for number in range(since + 1, live["revision"] + 1):
            for table, scan_, added in self.manifest(number)["touched"]:
                for own, mine, adds in changes:
                    known = own == table or (own == "contents" and table in ("entries", "hashes"))
                    same = known and (mine == scan_ or mine is None or scan_ is None)
                    if same and (read or not (adds and added)):
                        raise Refused(f"{table} has changed meanwhile", "SCENARIO_REVISION_CONFLICT")
        known = live["tables"].get("scans", {})
        if taken := [s for table, s, added in changes if table == "scans" and added and s in known]:
            raise Refused(f"scan {taken[0]} has been saved meanwhile", "SCENARIO_REVISION_CONFLICT")

    @staticmethod
    def _after(live: dict, changes: list, tables: dict, generation: str, same: bool) -> dict:
        out = dict(live)
        # counts that are kept of a scan hold no longer when its files change without them
        counted = {s for name, s, _ in changes if name == "contents"}
        changed = set() if same or None in counted else {s for name, s, _ in changes if name in ("entries", "hashes")} - counted
        if "contents" in out and changed:
            out["contents"] = {} if None in changed else {s: g for s, g in out["contents"].items() if s not in changed}
        for name, scan_, added in changes:
            old = out.get(name, {} if by_scan(name) else [])
            if not by_scan(name):
                out[name] = [*old, generation] if added else [generation]
            elif added:
                out[name] = old | {scan_: [*old.get(scan_, []), generation]}
            else:
                kept = {} if scan_ is None else {s: g for s, g in old.items() if s != scan_}
                out[name] = kept | {s: [generation] for s in tables[name]}
        for name in tables:  # an append without rows still makes the table
            out.setdefault(name, {} if by_scan(name) else [])
        return out

    def compact(self, *names: str) -> int:
        """Write tables anew, so that many small generations become one; refused if they change meanwhile."""
        found, generation = self.manifest(), uuid.uuid4().hex
        chosen = [n for n in names or found["tables"] if n in found["tables"]]
        new = {n: self.write(n, self.stored(n, found["revision"]), generation) for n in chosen}
        return self.publish([(n, None, False) for n in chosen], new, generation, found["revision"], same=True)

    def _create(self, revision: int, text: str) -> bool:
        """Make a manifest of this number unless there is one; it is whole when it is there.

        A link on a local file system, a rename that replaces nothing on others: both are
        atomic on file systems that have one name server.
        """
        live = self._path(self._log(revision))
        self._fs.mkdirs(live.getParent())
        if self._fs.getUri().getScheme() == "file":
            final = Path(str(self._fs.makeQualified(live).toUri().getPath()))
            new = final.with_name(f".{uuid.uuid4().hex}")
            new.write_text(text)
            try:
                os.link(new, final)
                return True
            except FileExistsError:
                return False
            finally:
                new.unlink()
        new = self._path(f"{self.folder}/_manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
        options[0] = jvm.Options.Rename.NONE
        try:
            jvm.FileContext.getFileContext(live.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(new, live, options)
            return True
        except Py4JJavaError:
            if not self._fs.exists(live):
                raise
            self._fs.delete(new, False)
            return False


def scan(inv: Inventory, name: str) -> dict:
    """One scan by its name."""
    found = inv.scans.filter(inv.scans.name == name).limit(1).collect()
    if not found:
        raise Refused(f"no scan is named {name!r}", "SCAN_NOT_FOUND")
    return found[0].asDict()


def required(inv: Inventory) -> None:
    """Refuse an inventory without its base tables."""
    if missing := [t for t in BASE if t not in inv.tables]:
        raise InvalidInventory(f"missing tables: {', '.join(missing)}")

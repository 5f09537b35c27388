"""The archives of a scan, analysed: found by name, read, hashed and looked into, level by level, and published.

A set of volumes is one piece of work, equal sets are read once, and what an earlier run
has read is taken from its results.  Archives within an archive, and sets of volumes within
it, are read by the task that reads it, from bytes kept in memory or in the shared folder.  Everything a task says leaves it as rows; nothing
but counts comes to the driver.

What is found in a content depends on how many levels are left to look into.  So a task
names its results by reader, content and levels left, and tells of each whether the levels
or an active ancestor cut it short.  After reading, results get their names: one that was not cut
is named by its content, whatever depth it was met at; one that was cut by its content and
the levels left; and one that met a fault that may pass keeps its reader's name.  Of those
that several tasks gave the same name, the rows of one stay.
"""

from __future__ import annotations

import hashlib
import io
import os
import uuid
from collections.abc import Generator, Iterator
from dataclasses import asdict, dataclass
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvault.errors import Refused
from tallyvault.functions import paths
from tallyvault.inventory import Inventory, Store, scan
from tallyvault.operators import archives
from tallyvault.schemas import SCHEMAS
from tallyvault.sources import hashing
from tallyvault.sources.archive_files import BROKEN, Joined, Kept, Limits, Scratch, local, walked
from tallyvault.storage import new_folder, settle

PROVIDER = "python-stdlib-1"
#: What a task tells: a row a result, member, error or nested archive.
ROWS = "what string, result_id string, ordinal long, relative_path string, kind string, declared_size long, actual_size long, modified_sec long, sha256 string, integrity string, encrypted boolean, group_key string, flavor string, slot int, child_result_id string, duplicate boolean, category string, code string, message string, source_label string, fingerprint string, state string, retryable boolean, reusable boolean, height int, reader string, final_id string, root boolean, told long"
_NAMES = [c.split()[0] for c in ROWS.split(", ")]
_WHOLE = ("ordinal", "declared_size", "actual_size", "modified_sec", "slot", "height", "told")


def policy_of(limits: Limits) -> str:
    """Of the limits that a result was made under; only results of the same limits are used again."""
    return "limits-" + hashlib.sha256(repr(sorted(asdict(limits).items())).encode()).hexdigest()[:16]


def id_of(run: str, fingerprint: str) -> str:
    """The result of a content in a run: the same for every task that meets it."""
    h = hashlib.md5(f"{run}/{fingerprint}".encode()).hexdigest()  # noqa: S324
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


@dataclass
class Facts:
    """What a parent needs of a result; cut: by the levels left ("levels"), or by what is being read above it ("ancestor")."""

    result: str
    state: str
    retryable: bool
    reusable: bool
    height: int
    cut: str | None


@dataclass
class Volume:
    """A member that is an archive or a part of one."""

    ordinal: int
    path: str
    flavor: str
    slot: int
    digest: str | None
    size: int | None
    body: Kept | None

    def order(self) -> tuple[int, int]:
        return (1 << 62 if self.flavor == "zip-split" and self.slot == 0 else self.slot), self.ordinal

    def dropped(self) -> None:
        if self.body is not None:
            self.body.drop()
            self.body = None


class Analyst:
    """Reads one archive and those within it; rows of each content and levels left once."""

    def __init__(self, run: str, reader: str, limits: Limits, scratch: Scratch):
        self.run, self.reader, self.limits, self.scratch = run, reader, limits, scratch
        self.whole: dict[str, Facts] = {}
        self.short: dict[tuple[str, int], Facts] = {}  # cut by levels alone

    def known(self, fingerprint: str, left: int) -> Facts | None:
        found = self.whole.get(fingerprint)
        return found if found and found.height <= left else self.short.get((fingerprint, left))

    def told(self, label: str, fingerprint: str, left: int, facts: Facts, rows: int, root: bool) -> dict:
        """The row of a finished result, with the name that it gets."""
        final = facts.result if facts.retryable or facts.cut == "ancestor" else id_of(self.run, f"{fingerprint}/{left}" if facts.cut else fingerprint)
        return {"what": "result", "result_id": facts.result, "final_id": final, "root": root, "told": rows + 1, "source_label": label, "fingerprint": fingerprint, "state": facts.state, "retryable": facts.retryable, "reusable": facts.reusable, "height": facts.height}

    def barred(self, label: str, fingerprint: str, left: int, why: str, above: tuple[str, ...]) -> Generator[dict, None, Facts]:
        """A result that nothing is read for: no level is left, or the content is being read above."""
        facts = Facts(id_of(self.run, f"{self.reader}/{above}/{fingerprint}/{why}"), "PARTIAL", False, False, 0, why)
        yield {"what": "error", "result_id": facts.result, "category": "LIMIT", "code": "DEPTH", "message": f"more than {self.limits.depth} levels" if why == "levels" else "within itself"}
        yield self.told(label, fingerprint, left, facts, 1, False)
        return facts

    def rows(self, label: str, name: str, data: BinaryIO, size: int, fingerprint: str, left: int, above: tuple[str, ...] = ()) -> Generator[dict, None, Facts]:
        above = (*above, fingerprint)
        result = id_of(self.run, f"{self.reader}/{above}/{left}")
        flags = {"OPERATIONAL": 0, "LIMIT": 0, "CAPABILITY": 0}
        errors, told, sound, later, height = 0, 0, True, False, 0
        cut: set[str] = set()
        sets: dict[str, list[Volume]] = {}

        def told_of(ordinal: int | None, category: str, code: str, message: str) -> dict:
            nonlocal errors
            errors += 1
            if category in flags:
                flags[category] += 1
            return {"what": "error", "result_id": result, "ordinal": ordinal or None, "category": category, "code": code, "message": message}

        def nested(path: str) -> bool:
            return left > 0 and archives.classified_name(path) is not None

        try:
            for row, body in walked(name, data, size, self.limits, nested, self.scratch):
                ordinal, path, kind, declared, actual, seconds, digest, integrity, encrypted, category, code, message = row
                found = archives.classified_name(path) if path and kind == "FILE" else None
                group, flavor, slot = found or (None, None, None)
                if ordinal:
                    told += 1
                    yield {"what": "member", "result_id": result, "ordinal": ordinal, "relative_path": path or f"unsafe-{ordinal}", "kind": kind, "declared_size": declared, "actual_size": actual, "modified_sec": seconds, "sha256": digest, "integrity": integrity, "encrypted": encrypted, "group_key": group, "flavor": flavor, "slot": slot, "message": message}
                if category:
                    yield told_of(ordinal, category, code, message)
                if found:
                    sets.setdefault(group, []).append(Volume(ordinal, path, flavor, slot, digest, actual, body))
            # sets of volumes, when all members are known, in the order of their first ones
            for group, volumes in sets.items():
                if any(v.digest is None for v in volumes):
                    if len(volumes) > 1:
                        yield told_of(volumes[0].ordinal, "CONTENT", "MISSING_VOLUMES", f"a volume of {group} was not read")
                    continue
                volumes.sort(key=Volume.order)
                first, title = min(v.ordinal for v in volumes), volumes[0].path
                missing, ambiguous, reader = archives.arrangement(volumes[0].flavor, [v.slot for v in volumes])
                if missing or ambiguous or len({v.flavor for v in volumes}) > 1:
                    yield told_of(first, *(("LIMIT", "AMBIGUOUS_VOLUMES") if ambiguous else ("CONTENT", "MISSING_VOLUMES")), f"the volumes of {group} are not one set")
                    continue
                if reader not in ("single", "zip-chunks") and len(volumes) > 1:
                    yield told_of(first, "CAPABILITY", "UNSUPPORTED", f"{reader} needs other tools")
                    continue
                child = archives.set_fingerprint([(v.slot, v.size, v.digest) for v in volumes], volumes[0].flavor)
                why = "levels" if left <= 0 else "ancestor" if child in above else None
                done = None if why else self.known(child, left - 1)
                if done:
                    facts = done
                elif why:
                    facts = yield from self.barred(title, child, left - 1, why, above)
                elif any(v.body is None for v in volumes):
                    yield told_of(first, "LIMIT", "NESTED_BYTES", "too large to be looked into")
                    continue
                else:
                    total = sum(v.size for v in volumes)
                    streams = [(v.body.open(), v.size) for v in volumes]
                    with streams[0][0] if len(streams) == 1 else io.BufferedReader(Joined(streams)) as data_:
                        facts = yield from self.rows(title, title if len(streams) == 1 else group.partition(":")[2], data_, total, child, left - 1, above)
                cut |= {facts.cut} - {None}
                sound, later, height = sound and facts.reusable, later or facts.retryable, max(height, facts.height + 1)
                told += 1
                yield {"what": "nested", "result_id": result, "ordinal": first, "group_key": group, "child_result_id": facts.result, "duplicate": done is not None}
                if facts.state != "COMPLETE":
                    yield told_of(first, "CHILD", "NESTED_ERRORS", f"{group} has errors or was not read to its end")
                for v in volumes:
                    v.dropped()
        finally:
            for volumes in sets.values():
                for v in volumes:
                    v.dropped()
        retryable = flags["OPERATIONAL"] > 0 or later
        reusable = not any(flags.values()) and sound and not retryable
        facts = Facts(result, "PARTIAL" if errors else "COMPLETE", retryable, reusable, height, min(cut, default=None))  # "ancestor" first
        if not cut:
            self.whole[fingerprint] = facts
        elif facts.cut == "levels":
            self.short[fingerprint, left] = facts
        yield self.told(label, fingerprint, left, facts, told + errors, len(above) == 1)
        return facts


def read(sets: DataFrame, run: str, limits: Limits) -> DataFrame:
    """The rows of each set: fingerprint, label, reader_flavor and its volumes (path, size, modified_sec, modified_nano) in order.

    A set whose volumes are not what the scan has recorded, before or after they are read, gives a row that says so.
    """

    # members that are read again lie in the shared folder, where it is one whose files can be opened by name, else in memory
    folder = local(new_folder(sets.sparkSession, "archives"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                held: list[dict] = []
                for row in attempt(r):
                    held.append(row)
                    if len(held) >= 10_000:
                        yield frame(held)
                        held = []
                yield frame(held)

    def changed(volumes: list) -> str | None:
        for v in volumes:
            now = os.stat(v["path"])
            if (now.st_size, *divmod(now.st_mtime_ns, 1_000_000_000)) != (v["size"], v["modified_sec"], v["modified_nano"]):
                return v["path"]
        return None

    def attempt(r) -> Iterator[dict]:
        volumes, reader = list(r.held), r.fingerprint
        files = [v["path"] for v in volumes]
        name = files[0] if r.reader_flavor == "single" or len(files) == 1 else r.label
        analyst = Analyst(run, reader, limits, Scratch(folder))
        try:
            if r.reader_flavor not in ("single", "zip-chunks"):
                raise NotImplementedError(f"{r.reader_flavor} needs other tools")
            told = changed(volumes)
            if told is None:
                with open(files[0], "rb") if len(files) == 1 else io.BufferedReader(Joined(files)) as data:
                    for row in analyst.rows(r.label, name, data, sum(map(os.path.getsize, files)), r.fingerprint, limits.depth):
                        yield row | {"reader": reader}
                told = changed(volumes)
            if told is not None:
                yield {"what": "changed", "reader": reader, "message": f"changed since it was scanned: {told}"}
        except BROKEN as e:
            # what was told before the fault is of no finished result, and goes
            tools = isinstance(e, NotImplementedError)
            facts = Facts(id_of(run, f"{reader}/failed"), "PARTIAL", not tools, False, 0, None)
            yield {"what": "error", "result_id": facts.result, "category": "CAPABILITY" if tools else "OPERATIONAL", "code": "UNSUPPORTED" if tools else "OPEN", "message": str(e), "reader": reader}
            yield analyst.told(r.label, r.fingerprint, limits.depth, facts, 1, True) | {"reader": reader}

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=_NAMES, dtype=object).astype({c: "Int64" for c in _WHOLE})

    return sets.select("fingerprint", "label", "reader_flavor", "held").mapInPandas(work, ROWS)


def _fitted(rows: DataFrame, table: str, **columns: Column) -> DataFrame:
    """A stored table's columns, from those given, those of the same name, or null."""
    return rows.select(*[(columns[f.name] if f.name in columns else F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields])


def analysed(inv: Inventory, name: str, limits: Limits = Limits(), partitions: int | None = None) -> dict[str, DataFrame]:  # noqa: B008
    """The archive tables of a scan: its run, inputs and jobs, and what was read anew of results and below.

    Volumes without a digest are hashed first.  A set whose volumes are missing, ambiguous
    or unreadable is skipped with a diagnostic.  Scans of other systems are refused.
    """
    own = scan(inv, name)
    id_, run, policy = own["scan_id"], uuid.uuid4().hex, policy_of(limits)
    found = settle(archives.inputs(inv, id_))
    known = inv.hashes.filter(F.col("scan_id") == id_).join(found.select(F.col("source_id").alias("entry_id")), "entry_id", "left_semi")
    bare = found.select("scan_id", F.col("source_id").alias("entry_id"), "relative_path", "size", "modified_sec", "modified_nano").join(known, ["scan_id", "entry_id"], "left_anti")
    digests = settle(known.select("scan_id", "entry_id", "sha256").unionByName(hashing.hashed(bare, inv.scans.filter(F.col("scan_id") == id_), partitions=partitions)[0]))
    prints = archives.fingerprints(found, digests).select("scan_id", "group_key", "fingerprint")
    path = paths.joined(F.lit(own["root"]), F.col("relative_path"))
    listed = found.groupBy("scan_id", "group_key").agg(F.sort_array(F.collect_list(F.struct(archives.volume_order(F.col("flavor"), F.col("slot")).alias("o"), "source_id", path.alias("path"), "size", "modified_sec", "modified_nano"))).alias("held"))
    listed = listed.withColumn("paths", F.col("held.path"))
    sets = settle(archives.arranged(found).join(prints, ["scan_id", "group_key"]).join(listed, ["scan_id", "group_key"]).withColumn("policy", F.lit(policy)))
    usable = sets.filter("not missing and not ambiguous and fingerprint is not null")
    cached = settle(archives.cached(usable.select("fingerprint", "policy").distinct(), inv.archive_results, limits.depth))
    # equal sets are read once, by the least name
    fresh = usable.join(cached.select("fingerprint"), "fingerprint", "left_anti")
    work = fresh.groupBy("fingerprint").agg(F.min(F.struct("group_key", F.element_at("paths", 1).alias("label"), "reader_flavor", "held")).alias("s")).select("fingerprint", "s.label", "s.reader_flavor", "s.held")
    told = settle(read(work.repartition(partitions or 4 * inv.spark.sparkContext.defaultParallelism, "fingerprint"), run, limits))
    rows = settle(archives.resolved(told))
    now = F.current_timestamp()
    results = rows.filter("what = 'result'").select("result_id", "source_label", "fingerprint", "state", "retryable", "reusable", "height")
    # the name that a set's own result has got
    roots = told.filter("what = 'result' and root").join(results.select(F.col("result_id").alias("final_id")), "final_id", "left_semi").select("fingerprint", F.col("final_id").alias("fresh_id"), "state", "retryable")
    changed = told.filter("what = 'changed'").select(F.col("reader").alias("fingerprint"), F.col("message").alias("changed"))
    made = roots.dropDuplicates(["fingerprint"])
    old = cached.select("fingerprint", F.col("result_id").alias("cached_id")).join(inv.archive_results.select(F.col("result_id").alias("cached_id"), F.col("state").alias("cached_state")), "cached_id")
    firsts = fresh.groupBy("fingerprint").agg(F.min("group_key").alias("first_key"))
    fate = sets.drop("held").join(old, "fingerprint", "left").join(made, "fingerprint", "left").join(changed, "fingerprint", "left").join(firsts, "fingerprint", "left")
    wrong = F.when(F.col("missing"), "volumes are missing").when(F.col("ambiguous"), "volumes are ambiguous").when(F.col("fingerprint").isNull(), "a volume could not be read").otherwise(F.col("changed"))
    jobs = archives.jobs(found).select("scan_id", "group_key", "first_entry", "flavor").join(fate.drop("flavor"), ["scan_id", "group_key"]).select(
        "scan_id", "group_key", "first_entry", "flavor", F.when(wrong.isNotNull(), "PARTIAL").otherwise(F.coalesce("cached_state", "state")).alias("status"), F.when(wrong.isNull(), F.coalesce("cached_id", "fresh_id")).alias("result_id"),
        (wrong.isNull() & (F.col("cached_id").isNotNull() | (F.col("group_key") != F.col("first_key")))).alias("duplicate"), F.coalesce(F.col("retryable") | F.col("fingerprint").isNull(), F.lit(False)).alias("retryable"), wrong.alias("diagnostic"),
    )
    jobs = settle(jobs)
    some = not jobs.filter("status <> 'COMPLETE' or diagnostic is not null").isEmpty()
    volumes = fresh.join(found.drop("flavor"), ["scan_id", "group_key"]).join(digests.withColumnRenamed("entry_id", "source_id"), ["scan_id", "source_id"])
    volumes = volumes.join(made.select("fingerprint", F.col("fresh_id").alias("result_id")), "fingerprint").join(firsts.select("fingerprint", F.col("first_key").alias("group_key")), ["fingerprint", "group_key"])
    order = archives.volume_order(F.col("flavor"), F.col("slot"))
    ordinal = F.expr("array_position(paths, _path)")
    volumes = volumes.withColumn("_order", order).withColumn("_path", path)
    return {
        "archive_runs": inv.spark.createDataFrame([(id_, "COMPLETE_WITH_ERRORS" if some else "COMPLETE")], SCHEMAS["archive_runs"]),
        "archive_inputs": _fitted(found, "archive_inputs"), "archive_jobs": _fitted(jobs, "archive_jobs"),
        "archive_results": _fitted(results, "archive_results", scan_id=F.lit(id_), policy=F.lit(policy), provider=F.lit(PROVIDER), started_at=now, completed_at=now),
        "archive_volumes": _fitted(volumes, "archive_volumes", ordinal=ordinal, source_path=F.col("relative_path")),
        "archive_members": _fitted(rows.filter("what = 'member'"), "archive_members", filename=F.substring_index("relative_path", "/", -1), modified_nano=F.lit(0), volume_slot=F.col("slot"), diagnostic=F.col("message")),
        "archive_nested": _fitted(rows.filter("what = 'nested'"), "archive_nested", parent_result_id=F.col("result_id"), source_ordinal=F.col("ordinal")),
        "archive_errors": _fitted(rows.filter("what = 'error'"), "archive_errors"),
    }


def publish(store: Store, name: str, limits: Limits = Limits()) -> str:  # noqa: B008
    """Analyse a scan's archives and save what was found; the phase of the run.

    Results of earlier runs stay, as other scans may lead to them.
    """
    inv = store.load()
    own = scan(inv, name)
    if own["phase"] not in ("COMPLETE", "COMPLETE_WITH_ERRORS", "READY"):
        raise Refused(f"{name!r} is not discovered to its end", "INVALID_INVENTORY")
    made = {t: settle(df) for t, df in analysed(inv, name, limits).items()}
    phase = made["archive_runs"].first()["phase"]
    added = tuple(t for t in made if t not in ("archive_runs", "archive_inputs", "archive_jobs"))
    store.save(None, own["scan_id"], added, base=inv.revision, **made)
    return phase

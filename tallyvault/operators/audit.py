"""The rules that a sound inventory keeps: each is a frame of the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvault.errors import InvalidInventory
from tallyvault.functions import paths
from tallyvault.functions.text import digest
from tallyvault.inventory import Inventory

Rules = dict[str, DataFrame]
_UUID = r"\A[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"


def twice(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().filter("count <> 1")


def dangling(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is null or leads nowhere."""
    known = parent.select(F.col(key).alias(column)).distinct()
    return df.join(known, column, "left_anti")


def outside(df: DataFrame, column: str, *allowed: str) -> DataFrame:
    return df.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))


def no_digest(df: DataFrame, column: str = "sha256") -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~digest(F.col(column)))


def bad_nanos(df: DataFrame) -> DataFrame:
    return df.filter((F.col("modified_nano") < 0) | (F.col("modified_nano") >= 1_000_000_000))


def differs(*pairs: tuple[str, str]) -> Column:
    """Whether any pair of columns is unequal, nulls being equal."""
    return reduce(lambda a, b: a | b, [~F.col(a).eqNullSafe(F.col(b)) for a, b in pairs])


def entries(inv: Inventory) -> Rules:
    e, s = inv.entries, inv.scans
    p = F.col("relative_path")
    root = F.col("entry_id") == 1
    bad_root = (F.col("parent_id") != 0) | (p != "") | (F.col("kind") != "DIRECTORY")
    dots = F.exists(F.split(p, "/", -1), lambda c: c.isin("", ".", ".."))
    bad_other = (F.col("parent_id") < 1) | (F.col("parent_id") >= F.col("entry_id")) | dots
    on_windows = e.join(F.broadcast(s.filter(paths.windows(F.col("root"))).select("scan_id", "root")), "scan_id")
    return {
        "scan id repeated": twice(s, "scan_id"), "scan name repeated": twice(s, "name"),
        "scan phase unknown": outside(s, "phase", "DISCOVERING", "READY", "HASHING", "COMPLETE", "COMPLETE_WITH_ERRORS"),
        "scan identity": s.filter((F.col("scan_id") <= 0) | (F.length(F.trim("name")) == 0) | (F.length("name") > 200) | (F.col("algorithm") != "SHA-256") | (F.col("next_entry_id") < 2)),
        "scan root": s.filter(paths.style(F.col("root")) == paths.UNKNOWN),
        "entry without scan": dangling(e, "scan_id", s, "scan_id"), "entry repeated": twice(e, "scan_id", "entry_id"), "path repeated": twice(e, "scan_id", "relative_path"),
        "entry kind unknown": outside(e, "kind", "DIRECTORY", "FILE", "SYMLINK", "OTHER"),
        "entry shape": e.filter((F.col("entry_id") < 1) | (F.col("size") < 0) | (F.col("modified_nano") < 0) | (F.col("modified_nano") >= 1_000_000_000) | F.when(root, bad_root).otherwise(bad_other)),
        "name not for Windows": on_windows.filter(~paths.valid_relative(F.col("root"), p)),
    }


def tree(inv: Inventory) -> Rules:
    e, s, d = inv.entries, inv.scans, inv.directories
    parent = e.select("scan_id", F.col("entry_id").alias("parent_id"), F.col("relative_path").alias("_above"), F.col("kind").alias("_kind"))
    placed = e.filter("entry_id <> 1").join(parent, ["scan_id", "parent_id"], "left")
    expected = F.concat(F.when(F.col("_above") == "", "").otherwise(F.concat("_above", F.lit("/"))), "filename")
    folders = e.filter("kind = 'DIRECTORY'").select("scan_id", "entry_id", F.col("parent_id").alias("_parent"), F.col("relative_path").alias("_path"), F.lit(True).alias("_there"))
    queue = d.withColumn("_queued", F.lit(True)).join(folders, ["scan_id", "entry_id"], "full_outer")
    above = d.select("scan_id", F.col("entry_id").alias("parent_id"), F.col("completed").alias("_done"))
    phases = F.broadcast(s.select("scan_id", "phase", "active_dir"))
    active = s.filter("active_dir is not null").join(d.select("scan_id", F.col("entry_id").alias("active_dir"), "completed"), ["scan_id", "active_dir"], "left")
    return {
        "root missing": s.join(e.filter("entry_id = 1"), "scan_id", "left_anti"),
        "parent or path": placed.filter(F.col("_kind").isNull() | (F.col("_kind") != "DIRECTORY") | (F.col("relative_path") != expected) | F.col("filename").isin("", ".", "..") | F.col("filename").contains("/")),
        "next entry id": e.join(F.broadcast(s.select("scan_id", "next_entry_id")), "scan_id").filter("entry_id >= next_entry_id"),
        "queue is not the directories": queue.filter(F.col("_queued").isNull() | F.col("_there").isNull() | (F.col("parent_id") != F.col("_parent")) | (F.col("relative_path") != F.col("_path"))),
        "active directory": active.filter((F.col("phase") != "DISCOVERING") | F.col("completed").isNull() | F.col("completed")),
        "open directory after discovery": d.filter("not completed").join(phases, "scan_id").filter("phase <> 'DISCOVERING'"),
        "child done before its parent": d.filter("completed").join(above, ["scan_id", "parent_id"]).filter("not _done"),
        "entry under an open directory": e.join(above, ["scan_id", "parent_id"]).filter("not _done").join(phases, "scan_id").filter(~F.col("parent_id").eqNullSafe(F.col("active_dir"))),
    }


def hashes(inv: Inventory) -> Rules:
    h = inv.hashes
    return {
        "digest repeated": twice(h, "scan_id", "entry_id"), "digest of no file": h.join(inv.entries.filter("kind = 'FILE'"), ["scan_id", "entry_id"], "left_anti"), "digest shape": no_digest(h),
        "digest during discovery": h.join(F.broadcast(inv.scans.filter("phase = 'DISCOVERING'")), "scan_id", "left_semi"),
    }


def _runs(inv: Inventory, feature: str) -> Rules:
    runs = getattr(inv, f"{feature}_runs")
    return {
        f"{feature} run without scan": dangling(runs, "scan_id", inv.scans, "scan_id"),
        f"{feature} run phase": outside(runs, "phase", "IDENTIFYING", "ANALYZING", "PAUSED", "COMPLETE", "COMPLETE_WITH_ERRORS"),
        f"{feature} run during discovery": runs.join(inv.scans.filter("phase = 'DISCOVERING'"), "scan_id", "left_semi"),
        f"{feature} result id": getattr(inv, f"{feature}_results").filter(~F.col("result_id").rlike(_UUID)),
    }


def _same_as_inventory(rows: DataFrame, inv: Inventory) -> DataFrame:
    known = inv.entries.select("scan_id", F.col("entry_id").alias("source_id"), *[F.col(c).alias(f"_{c}") for c in ("kind", "relative_path", "size", "modified_sec", "modified_nano")])
    joined = rows.join(known, ["scan_id", "source_id"], "left")
    return joined.filter(F.coalesce(F.col("_kind") != "FILE", F.lit(True)) | differs(*[(c, f"_{c}") for c in ("relative_path", "size", "modified_sec", "modified_nano")]))


def archive(inv: Inventory) -> Rules:
    i, j, r, v, m, n, x = (getattr(inv, f"archive_{t}") for t in ("inputs", "jobs", "results", "volumes", "members", "nested", "errors"))
    result = r.select("result_id", F.col("state").alias("_state"))
    jobs = j.join(result, "result_id", "left")
    sets = i.groupBy("scan_id", "group_key").agg(F.min("source_id").alias("_first"), F.min("flavor").alias("_flavor"), F.count_distinct("flavor").alias("_flavors"))
    of = n.join(m.select(F.col("result_id").alias("parent_result_id"), F.col("ordinal").alias("source_ordinal"), "kind", "sha256", F.col("group_key").alias("_key")), ["parent_result_id", "source_ordinal"], "left")
    heights = n.join(r.select(F.col("result_id").alias("parent_result_id"), F.col("height").alias("_a")), "parent_result_id").join(r.select(F.col("result_id").alias("child_result_id"), F.col("height").alias("_b")), "child_result_id")
    sound = F.col("kind").eqNullSafe("FILE") & F.col("integrity").eqNullSafe("READ_OK") & (F.coalesce("actual_size", F.lit(-1)) >= 0) & F.col("recovered_sha256").isNull()
    short = (F.col("integrity") == "READ_OK") & (F.col("sha256").isNull() | F.coalesce(F.col("declared_size") != F.col("actual_size"), F.lit(False)))
    return _runs(inv, "archive") | {
        "archive input without run": dangling(i, "scan_id", inv.archive_runs, "scan_id"), "archive job without run": dangling(j, "scan_id", inv.archive_runs, "scan_id"), "archive result without scan": dangling(r, "scan_id", inv.scans, "scan_id"),
        "archive job status": outside(j, "status", "PENDING", "COMPLETE", "PARTIAL", "SKIPPED"), "archive result state": outside(r, "state", "COMPLETE", "PARTIAL", "SKIPPED"),
        "archive input repeated": twice(i, "scan_id", "source_id"), "archive volume repeated": twice(v, "result_id", "ordinal"), "archive member repeated": twice(m, "result_id", "ordinal"), "nested set repeated": twice(n, "parent_result_id", "group_key"),
        "archive volume without result": dangling(v, "result_id", r, "result_id"), "archive member without result": dangling(m, "result_id", r, "result_id"), "archive error without result": dangling(x, "result_id", r, "result_id"),
        "nesting without parent": dangling(n, "parent_result_id", r, "result_id"), "nesting without child": dangling(n, "child_result_id", r, "result_id"),
        "archive input differs": _same_as_inventory(i, inv), "archive input set": i.filter(F.col("group_key").isNull() | F.col("flavor").isNull() | (F.coalesce("slot", F.lit(-1)) < 0)),
        "archive jobs are not the sets": j.join(sets, ["scan_id", "group_key"], "left").filter(F.col("_first").isNull() | differs(("first_entry", "_first"), ("flavor", "_flavor")) | (F.col("_flavors") != 1)),
        "archive set without job": i.join(inv.archive_runs.filter("phase <> 'IDENTIFYING'"), "scan_id", "left_semi").join(j, ["scan_id", "group_key"], "left_anti"),
        "archive job flags": j.filter("duplicate is null or retryable is null or (status = 'PARTIAL' and result_id is null and diagnostic is null)"),
        "archive job result": jobs.filter("(result_id is not null and (_state is null or status <> _state)) or (result_id is null and (status in ('COMPLETE', 'SKIPPED') or duplicate))"),
        "archive result unfinished": r.filter("completed_at is null or height < 0 or policy is null or provider is null or (state = 'SKIPPED' and (reusable or retryable))"),
        "archive volume ordinal": v.filter("ordinal is null or ordinal < 1"), "archive member ordinal": m.filter("ordinal is null or ordinal < 1"),
        "archive member kind": outside(m, "kind", "FILE", "DIRECTORY", "SYMLINK", "HARDLINK", "OTHER"), "archive member integrity": outside(m, "integrity", "READ_OK", "DAMAGED", "UNREADABLE", "METADATA", "SKIPPED", "ENCRYPTED"),
        "archive member time": bad_nanos(m), "archive volume facts": v.filter("coalesce(source_id, 0) < 1 or coalesce(size, -1) < 0 or coalesce(slot, -1) < 0"),
        "archive volume digest": no_digest(v), "archive member digest": no_digest(m), "recovered digest": no_digest(m, "recovered_sha256"),
        "archive member read": m.filter((F.col("sha256").isNotNull() & ~sound) | short), "skipped archive has members": m.join(r.filter("state = 'SKIPPED'"), "result_id", "left_semi"),
        "nested source": of.filter(F.coalesce(F.col("kind") != "FILE", F.lit(True)) | F.col("sha256").isNull() | differs(("_key", "group_key"))), "nesting does not descend": heights.filter("_a <= _b"),
    }


def image(inv: Inventory) -> Rules:
    j, r, c, p, f, e, x = (getattr(inv, f"image_{t}") for t in ("jobs", "results", "components", "partitions", "filesystems", "entries", "errors"))
    jobs = j.join(r.select("result_id", F.col("state").alias("_state")), "result_id", "left")
    primary = j.select("scan_id", F.col("source_id").alias("component_of"), F.col("state").alias("_primary"))
    owned = j.join(primary, ["scan_id", "component_of"], "left")
    files = inv.entries.filter("kind = 'FILE'").select("scan_id", F.col("entry_id").alias("source_id"), F.col("relative_path").alias("_path"), F.col("size").alias("_size"))
    provenance = c.join(r.select("result_id", "scan_id"), "result_id").join(files, ["scan_id", "source_id"], "left")
    parent = c.select("result_id", F.col("ordinal").alias("parent_ordinal"), F.col("ordinal").alias("_parent"))
    tree_ = c.join(parent, ["result_id", "parent_ordinal"], "left")
    fatal = x.filter(F.col("code").isin("SOURCE_CHANGED", "NATIVE_PROCESS_ERROR")).select("result_id")
    kept = x.join(fatal, "result_id", "left_anti")
    read = F.col("kind").eqNullSafe("FILE") & F.col("integrity").eqNullSafe("READ_OK") & (F.coalesce("actual_size", F.lit(-1)) >= 0) & F.col("actual_size").eqNullSafe(F.col("size"))
    return _runs(inv, "image") | {
        "image job without run": dangling(j, "scan_id", inv.image_runs, "scan_id"), "image result without scan": dangling(r, "scan_id", inv.scans, "scan_id"),
        "image job state": outside(j, "state", "PENDING", "COMPLETE", "PARTIAL", "COMPONENT"), "image result state": outside(r, "state", "COMPLETE", "PARTIAL"), "image job differs": _same_as_inventory(j, inv),
        "image result of no file": r.join(files, ["scan_id", "source_id"], "left_anti"),
        "image component job": owned.filter("(state = 'COMPONENT' and (component_of is null or _primary is null or source_id = component_of or _primary = 'COMPONENT')) or (state <> 'COMPONENT' and component_of is not null)"),
        "image job result": jobs.filter("(result_id is not null and (_state is null or (state not in ('PENDING', 'COMPONENT') and state <> _state))) or (result_id is null and (state = 'COMPLETE' or duplicate))"),
        "image result unfinished": r.filter("completed_at is null or policy is null or provider is null or (reusable and (state <> 'COMPLETE' or retryable))"),
        "image component repeated": twice(c, "result_id", "ordinal"), "image partition repeated": twice(p, "result_id", "device", "number"), "filesystem repeated": twice(f, "result_id", "filesystem_id"), "filesystem device repeated": twice(f, "result_id", "device"),
        "guest entry repeated": twice(e, "result_id", "filesystem_id", "entry_id"), "guest path repeated": twice(e, "result_id", "filesystem_id", "relative_path"),
        **{f"image {t} without result": dangling(df, "result_id", r, "result_id") for t, df in (("component", c), ("partition", p), ("filesystem", f), ("entry", e), ("error", x))},
        "filesystem identity": f.filter("coalesce(filesystem_id, 0) < 1 or device is null"), "filesystem state": outside(f, "state", "COMPLETE", "PARTIAL", "UNMOUNTABLE", "ENCRYPTED", "NOT_A_FILESYSTEM"),
        "guest entry without filesystem": e.join(f, ["result_id", "filesystem_id"], "left_anti"), "guest identity": e.filter("coalesce(entry_id, 0) < 1 or coalesce(filesystem_id, 0) < 1 or relative_path is null or filename is null"),
        "guest kind": outside(e, "kind", "FILE", "DIRECTORY", "SYMLINK", "OTHER"), "guest integrity": outside(e, "integrity", "READ_OK", "UNREADABLE", "METADATA_ONLY"), "guest time": bad_nanos(e), "component time": bad_nanos(c),
        "guest digest": no_digest(e), "component digest": no_digest(c), "guest read": e.filter((F.col("sha256").isNotNull() & ~read) | ((F.col("integrity") == "READ_OK") & F.col("sha256").isNull())),
        "component differs": provenance.filter(F.col("_path").isNull() | differs(("relative_path", "_path"), ("size", "_size")) | (F.coalesce("ordinal", F.lit(-1)) < 0)),
        "component tree": tree_.filter("parent_ordinal is null or parent_ordinal < -1 or (parent_ordinal = -1 and (ordinal <> 0 or role <> 'PRIMARY')) or (parent_ordinal >= 0 and (_parent is null or _parent >= ordinal))"),
        "image error without filesystem": kept.filter("filesystem_id is not null").join(f, ["result_id", "filesystem_id"], "left_anti"),
        "image error without entry": kept.filter("entry_id is not null").join(e, ["result_id", "filesystem_id", "entry_id"], "left_anti"),
    }


def rules(inv: Inventory) -> Rules:
    """All rules for the features that an inventory has."""
    out = entries(inv) | tree(inv) | hashes(inv)
    for feature, more in (("archive", archive), ("image", image)):
        if feature in inv.features():
            out |= more(inv)
    return out


def counted(found: Rules) -> DataFrame:
    """rule and failures, a row for each rule, in one job."""
    frames = [df.agg(F.count("*").alias("failures")).select(F.lit(rule).alias("rule"), "failures") for rule, df in found.items()]
    return reduce(DataFrame.unionByName, frames)


def require(inv: Inventory) -> None:
    broken = counted(rules(inv)).filter("failures > 0").collect()
    if broken:
        raise InvalidInventory("; ".join(f"{r['rule']}: {r['failures']}" for r in broken))

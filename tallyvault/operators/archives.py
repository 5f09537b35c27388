"""Archives: candidates by name, volume sets, results and their nested graph."""

from __future__ import annotations

import hashlib
import re
import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvault.errors import Refused
from tallyvault.inventory import Inventory, scan
from tallyvault.operators import dag, hot
from tallyvault.operators import predicates as P
from tallyvault.storage import settle

# fixed values: file names of archives and their volumes, the first that fits counts: (pattern of stem and number, flavor, added to the number)
NAMES = (
    (r"(.*)\.part([0-9]+)\.rar", "rar-parts", 0),
    (r"(.*\.7z)\.([0-9]+)", "7z-split", 0),
    (r"(.*\.zip)\.([0-9]+)", "zip-chunks", 0),
    (r"(.*)\.r([0-9]{2,3})", "rar-old", 1),
    (r"(.*)\.z([0-9]{2,3})", "zip-split", 0),
    (r"(.*)\.rar()", "rar-old", 0),
    (r"(.*)\.zip()", "zip-split", 0),
)
CANDIDATE = r"(?i)\.(zip|tar|tgz|tbz2?|txz|tzst|gz|bz2|xz|zst|rar|7z|r[0-9]{2,3}|z[0-9]{2,3}|7z\.[0-9]+|zip\.[0-9]+)\z"
SINGLE = r"(?is)\A.*\.(tar|tgz|tbz2?|txz|tzst|gz|bz2|xz|zst|7z)\z"
MOST_SLOT = 2**31 - 1
VISIBLE = ("COMPLETE", "PARTIAL", "SKIPPED")
#: First bytes of what a set's digest covers; inventories that are to share digests share the tag.
SET_TAG = "ARCHIVE-SET-V1"


def classified(path: Column) -> Column:
    """group_key, flavor and slot of a file that may be an archive or a volume of one, by its name alone; else null."""
    name = F.substring_index(path, "/", -1)
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(name))

    def found(flavor: str, stem: Column, slot: Column) -> Column:
        return F.struct(F.concat(F.lit(f"{flavor}:"), stem).alias("group_key"), F.lit(flavor).alias("flavor"), slot.alias("slot"))

    fits = []
    for pattern, flavor, plus in NAMES:
        whole = rf"(?is)\A{pattern}\z"
        number = F.regexp_extract(name, whole, 2)
        counted = F.coalesce(number.try_cast("int"), F.lit(MOST_SLOT)).cast("long") + plus
        slot = F.when(number == "", 0).otherwise(F.least(counted, F.lit(MOST_SLOT)).cast("int")).cast("int")
        fits.append(F.when(name.rlike(whole), found(flavor, F.concat(folder, F.regexp_extract(name, whole, 1)), slot)))
    return F.coalesce(*fits, F.when(name.rlike(SINGLE), found("single", path, F.lit(0))))


def classified_name(path: str) -> tuple[str, str, int] | None:
    """The same for one name in hand."""
    folder, _, name = path.rpartition("/")
    for pattern, flavor, plus in NAMES:
        if m := re.fullmatch(pattern, name, re.IGNORECASE | re.DOTALL | re.ASCII):
            return f"{flavor}:{folder + '/' if folder else ''}{m[1]}", flavor, min(int(m[2]) + plus, MOST_SLOT) if m[2] else 0
    return (f"single:{path}", "single", 0) if re.search(SINGLE.replace(r"\z", r"\Z"), name) else None


def inputs(inv: Inventory, scan_id: int) -> DataFrame:
    """Files of a scan that may be archives or volumes, with the set each belongs to."""
    files = inv.entries.filter((F.col("scan_id") == scan_id) & (F.col("kind") == "FILE") & F.col("filename").rlike(CANDIDATE))
    made = files.withColumn("_c", classified(F.col("relative_path"))).filter("_c is not null")
    return made.select("scan_id", "_c.group_key", "_c.flavor", "_c.slot", F.col("entry_id").alias("source_id"), "relative_path", "size", "modified_sec", "modified_nano")


def jobs(found: DataFrame) -> DataFrame:
    """One piece of work for each set."""
    return found.groupBy("scan_id", "group_key").agg(F.min("source_id").alias("first_entry"), F.min("flavor").alias("flavor")).select(
        "scan_id", "group_key", "first_entry", "flavor", F.lit("PENDING").alias("status"), F.lit(None).cast("string").alias("result_id"), F.lit(False).alias("duplicate"), F.lit(False).alias("retryable"), F.lit(None).cast("string").alias("diagnostic")
    )


def arranged(found: DataFrame) -> DataFrame:
    """Of each set whether volumes are missing or ambiguous, and how it is to be read.

    Slots count from 1, those of rar-old from 0; a zip-split needs slot 0, which is its
    last part, and 1 to the highest.  A lone slot 0 is read as a single file.
    """
    slot = F.col("slot")
    facts = found.groupBy("scan_id", "group_key", "flavor").agg(
        F.count("*").alias("volumes"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("least"), F.max("slot").alias("most"), F.count_distinct(F.when(slot > 0, slot)).alias("numbered"), F.bool_or(slot == 0).alias("zero"), F.count_if(slot > 0).alias("numbered_volumes")
    )
    first = F.when(F.col("flavor") == "rar-old", 0).otherwise(1)
    gaps = (F.col("least") != first) | (F.col("most").cast("long") - F.col("least") + 1 != F.col("volumes"))
    split = ~F.col("zero") | (F.col("numbered_volumes") != F.when(F.col("numbered") > 0, F.col("most")).otherwise(0)) | (F.col("numbered") != F.col("numbered_volumes"))
    twice = F.col("slots") < F.col("volumes")
    missing = F.when(F.col("flavor") == "single", False).when(F.col("flavor") == "zip-split", split).otherwise(gaps | twice)
    lone = (F.col("volumes") == 1) & F.col("zero")
    return facts.select("scan_id", "group_key", "flavor", "volumes", missing.alias("missing"), twice.alias("ambiguous"), F.when(lone, "single").otherwise(F.col("flavor")).alias("reader_flavor"))


def arrangement(flavor: str, slots: list[int]) -> tuple[bool, bool, str]:
    """The same for one set in hand: missing, ambiguous, and how it is to be read."""
    numbered = [s for s in slots if s > 0]
    twice = len(set(slots)) < len(slots)
    if flavor == "single":
        missing = False
    elif flavor == "zip-split":
        missing = 0 not in slots or len(numbered) != max(numbered, default=0) or len(set(numbered)) != len(numbered)
    else:
        missing = twice or min(slots) != (0 if flavor == "rar-old" else 1) or max(slots) - min(slots) + 1 != len(slots)
    return missing, twice, "single" if slots == [0] else flavor


def volume_order(flavor: Column, slot: Column) -> Column:
    return F.when((flavor == "zip-split") & (slot == 0), F.lit(2**62)).otherwise(slot.cast("long"))


def packed_text(column: Column) -> Column:
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(column)), 4, "0")), column.cast("binary"))


def packed_number(column: Column, digits: int) -> Column:
    return F.unhex(F.lpad(F.hex(column.cast("long")), digits, "0"))


def fingerprints(found: DataFrame, digests: DataFrame, tag: str = SET_TAG) -> DataFrame:
    """The content of each set as one digest: a single file's own, else one over tag, flavor, count and the volumes in order.

    A set without all digests has none.  A set has as many volumes as its files have numbers.
    """
    known = found.join(digests.select("scan_id", F.col("entry_id").alias("source_id"), "sha256"), ["scan_id", "source_id"], "left")
    volume = F.struct(volume_order(F.col("flavor"), F.col("slot")).alias("o"), "source_id", "slot", "size", "sha256")
    sets = known.groupBy("scan_id", "group_key", "flavor").agg(F.sort_array(F.collect_list(volume)).alias("v"), F.bool_and(F.col("sha256").isNotNull()).alias("whole"))
    body = F.aggregate("v", F.unhex(F.lit("")), lambda a, v: F.concat(a, packed_number(v["slot"], 8), packed_number(v["size"], 16), F.unhex(v["sha256"])))
    joint = F.concat(F.lit("set-v1-sha256:"), F.sha2(F.concat(packed_text(F.lit(tag)), packed_text(F.col("flavor")), packed_number(F.size("v"), 8), body), 256))
    alone = (F.size("v") == 1) & (F.col("v")[0]["slot"] == 0)
    return sets.select("scan_id", "group_key", "flavor", F.size("v").alias("volumes"), F.when(F.col("whole"), F.when(alone, F.concat(F.lit("file-sha256:"), F.col("v")[0]["sha256"])).otherwise(joint)).alias("fingerprint"))


def set_fingerprint(volumes: list[tuple[int, int, str]], flavor: str, tag: str = SET_TAG) -> str:
    """The same for one set in hand: (slot, size, sha256) in order."""
    if len(volumes) == 1 and volumes[0][0] == 0:
        return f"file-sha256:{volumes[0][2]}"
    body = b"".join(struct.pack(">H", len(t.encode())) + t.encode() for t in (tag, flavor)) + struct.pack(">i", len(volumes))
    body += b"".join(struct.pack(">iq", slot, size) + bytes.fromhex(digest) for slot, size, digest in volumes)
    return f"set-v1-sha256:{hashlib.sha256(body).hexdigest()}"


def cached(wanted: DataFrame, results: DataFrame, depth: int) -> DataFrame:
    """For each (fingerprint, policy) wanted the oldest result that can be used again and is not too high."""
    fit = results.filter(F.col("reusable") & F.col("state").isin("COMPLETE", "PARTIAL") & (F.col("height") <= depth))
    joined = wanted.join(fit, ["fingerprint", "policy"])
    return joined.groupBy("fingerprint", "policy").agg(F.min(F.struct("completed_at", "result_id"))["result_id"].alias("result_id"))


def outcome(errors: DataFrame, results: DataFrame, children: DataFrame) -> DataFrame:
    """State, flags and height of finished attempts: complete without errors, retryable after operational ones or if a child is
    (child_retryable, where it is given), reusable if the end was reached without limits and every child is reusable, one higher than the highest child."""
    flags = errors.groupBy("result_id").agg(F.count_if(F.col("category") == "OPERATIONAL").alias("operational"), F.count_if(F.col("category").isin("LIMIT", "CAPABILITY")).alias("limits"), F.count("*").alias("errors"))
    children = children if "child_retryable" in children.columns else children.withColumn("child_retryable", F.lit(None).cast("boolean"))
    below = children.groupBy("result_id").agg(F.bool_and("child_reusable").alias("sound"), F.bool_or("child_retryable").alias("later"), (F.max("child_height") + 1).alias("above"))
    known = results.join(flags, "result_id", "left").join(below, "result_id", "left").fillna(0, ["operational", "limits", "errors"])
    return known.select(
        "result_id", F.when(F.col("errors") == 0, "COMPLETE").otherwise("PARTIAL").alias("state"), ((F.col("operational") > 0) | F.coalesce("later", F.lit(False))).alias("retryable"),
        (F.col("ended") & F.col("whole") & (F.col("operational") == 0) & ~F.coalesce("later", F.lit(False)) & (F.col("limits") == 0) & F.coalesce("sound", F.lit(True))).alias("reusable"), F.coalesce("above", F.lit(0)).cast("int").alias("height"),
    )


def resolved(rows: DataFrame) -> DataFrame:
    """What tasks told (what, reader, result_id, ordinal, child_result_id, and of a result its final_id and how many rows it has) under the results' final names.

    Each result's rows are those of one task.  Those of sets that changed meanwhile, or of no finished result, go.
    """
    sound = rows.join(rows.filter("what = 'changed'").select("reader"), "reader", "left_anti")
    named = settle(sound.filter("what = 'result'").select(F.col("result_id").alias("own"), "final_id", "told"))
    chosen = named.groupBy("final_id").agg(F.min_by(F.struct("own", "told"), "own").alias("c")).select(F.col("c.own").alias("result_id"), F.col("final_id").alias("name"), F.col("c.told").alias("told"))
    kept = hot.joined(sound.drop("told"), chosen, ["result_id"], "told", ["ordinal", "what"])
    children = named.select(F.col("own").alias("child_result_id"), F.col("final_id").alias("child"))
    nested = kept.filter("what = 'nested'").join(children, "child_result_id").withColumn("child_result_id", F.col("child")).drop("child")
    rest = kept.filter("what <> 'nested'")
    return rest.unionByName(nested.select(*rest.columns)).withColumn("result_id", F.col("name")).drop("name")


def nested_sets(inv: Inventory, result_id: str) -> DataFrame:
    """The archives within one result, in the order their first member stands."""
    own = inv.archive_members.filter((F.col("result_id") == result_id) & F.col("group_key").isNotNull())
    sets = own.groupBy("group_key").agg(F.min("flavor").alias("flavor"), F.min("ordinal").alias("first"))
    # one result's sets only
    return sets.select(F.row_number().over(Window.orderBy("first", "group_key")).alias("sequence"), "group_key", "flavor", F.col("first").alias("source_ordinal"))


def reached(inv: Inventory, scan_id: int) -> DataFrame:
    """result_id: every result that a scan's archives lead to."""
    roots = inv.archive_jobs.filter(F.col("scan_id") == scan_id).select(F.col("result_id").alias("node"))
    edges = inv.archive_nested.select(F.col("parent_result_id").alias("parent"), F.col("child_result_id").alias("child"))
    return dag.reachable(roots, edges).withColumnRenamed("node", "result_id")


def listed(inv: Inventory, name: str) -> DataFrame:
    """Where archives were found: a scan's own, and those within reached results."""
    id_ = scan(inv, name)["scan_id"]
    facts = inv.archive_results.select("result_id", "state", "fingerprint", "provider", "reusable", "retryable", "height")
    own = inv.archive_jobs.filter(F.col("scan_id") == id_).join(facts.drop("state"), "result_id", "left")
    columns = ["location_kind", "source", "parent_result_id", "result_id", "status", "duplicate", "diagnostic", "fingerprint", "provider", "reusable", "retryable", "height"]
    # of the job's own flags only the first is shown
    roots = own.drop(inv.archive_jobs["retryable"]).select(F.lit("ROOT").alias("location_kind"), F.col("group_key").alias("source"), F.lit(None).cast("string").alias("parent_result_id"), *columns[3:])
    inner = inv.archive_nested.join(reached(inv, id_).withColumnRenamed("result_id", "parent_result_id"), "parent_result_id", "left_semi")
    inner = inner.join(facts.withColumnRenamed("result_id", "child_result_id"), "child_result_id")
    nested = inner.select(
        F.lit("NESTED").alias("location_kind"), F.col("group_key").alias("source"), "parent_result_id", F.col("child_result_id").alias("result_id"), F.col("state").alias("status"), "duplicate", F.lit(None).cast("string").alias("diagnostic"), *columns[7:]
    )
    return roots.unionByName(nested).orderBy("location_kind", "source")


def status(inv: Inventory, name: str) -> DataFrame:
    """One row of counts; a result that is reached over several paths counts once."""
    id_ = scan(inv, name)["scan_id"]
    phase = inv.archive_runs.filter(F.col("scan_id") == id_).select("phase").limit(1).collect()
    own = inv.archive_jobs.filter(F.col("scan_id") == id_)
    s = F.col("status")
    roots = own.agg(
        F.count("*").alias("root_archives"), F.count_if(s == "COMPLETE").alias("completed"), F.count_if(s == "PARTIAL").alias("with_errors"), F.count_if(s == "SKIPPED").alias("skipped"), F.count_if(s.isin("PENDING", "RUNNING")).alias("pending"),
        F.count_if("duplicate").alias("duplicate_roots"), F.count_if("retryable").alias("retryable_roots"), F.count("diagnostic").alias("_diagnostics"),
    )
    seen = reached(inv, id_)
    final = inv.archive_results.filter(F.col("state").isin("COMPLETE", "PARTIAL")).join(seen, "result_id", "left_semi").select("result_id")
    read = F.col("integrity")
    members = inv.archive_members.join(final, "result_id", "left_semi").agg(
        F.count("*").alias("indexed_members"), F.count_if(F.col("sha256").isNotNull() & (read == "READ_OK")).alias("checksummed_members"), F.count_if(read == "DAMAGED").alias("damaged_members"), P.total(F.col("actual_size")).alias("recovered_bytes")
    )
    errors = inv.archive_errors.join(seen, "result_id", "left_semi").agg(F.count("*").alias("_errors"))
    nested = inv.archive_nested.join(seen.withColumnRenamed("result_id", "parent_result_id"), "parent_result_id", "left_semi").agg(F.count("*").alias("nested_archives"))
    out = roots.crossJoin(members).crossJoin(errors).crossJoin(nested)  # one row each
    return out.withColumn("errors", F.col("_errors") + F.col("_diagnostics")).drop("_errors", "_diagnostics").select(F.lit(id_).cast("long").alias("scan_id"), F.lit(name).alias("name"), F.lit(phase[0][0] if phase else "NOT_STARTED").alias("phase"), "*")


def errors(inv: Inventory, name: str) -> DataFrame:
    id_ = scan(inv, name)["scan_id"]
    own = inv.archive_errors.join(reached(inv, id_), "result_id", "left_semi").select("result_id", "ordinal", "category", "code", "message")
    jobs_ = inv.archive_jobs.filter((F.col("scan_id") == id_) & F.col("diagnostic").isNotNull())
    return own.unionByName(jobs_.select("result_id", F.lit(None).cast("long").alias("ordinal"), F.lit("OPERATIONAL").alias("category"), F.lit("JOB_ERROR").alias("code"), F.col("diagnostic").alias("message")))


def _final(inv: Inventory, result_id: str) -> None:
    state = inv.archive_results.filter(F.col("result_id") == result_id).select("state").limit(1).collect()
    if not state or state[0][0] not in VISIBLE:
        raise Refused("no such result, or it is not finished", "NOT_FOUND")


def members(inv: Inventory, result_id: str) -> DataFrame:
    """A finished result's members in order, without what only the analysis needs."""
    _final(inv, result_id)
    return inv.archive_members.filter(F.col("result_id") == result_id).drop("group_key", "flavor", "volume_slot").orderBy("ordinal")


def volumes(inv: Inventory, result_id: str) -> DataFrame:
    _final(inv, result_id)
    return inv.archive_volumes.filter(F.col("result_id") == result_id).orderBy("ordinal")

"""Disk images: candidates by name, results with their guest files, and component trees."""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvault.errors import InvalidInventory, Refused
from tallyvault.inventory import Inventory, scan
from tallyvault.operators import predicates as P
from tallyvault.operators.archives import packed_number, packed_text

#: The format behind each file extension.
FORMATS = {"vmdk": "vmdk", "qcow": "qcow", "qcow2": "qcow2", "vdi": "vdi", "vhd": "vpc", "vpc": "vpc", "vhdx": "vhdx", "qed": "qed", "img": "raw", "raw": "raw", "dd": "raw", "iso": "raw", "dmg": "dmg"}
FINAL = ("COMPLETE", "PARTIAL")
#: First bytes of what an image set's digest covers; see the archives' tag.
CONTENT_TAG, SHAPE_TAG = "IMAGE-SET-1", "IMAGE-SHAPE-1"


def image_format(filename: Column) -> Column:
    """The format that a file's extension names, or null."""
    extension = F.lower(F.regexp_extract(filename, r"\.([^.]+)\z", 1))
    return F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])[extension]


def identified(inv: Inventory, scan_id: int) -> DataFrame:
    """New work: files of a scan that may be images and have none yet."""
    files = inv.entries.filter((F.col("scan_id") == scan_id) & (F.col("kind") == "FILE")).withColumn("format", image_format(F.col("filename"))).filter("format is not null")
    known = inv.image_jobs.select("scan_id", F.col("source_id").alias("entry_id"))
    return files.join(known, ["scan_id", "entry_id"], "left_anti").select("scan_id", F.col("entry_id").alias("source_id"), "relative_path", "format", "size", "modified_sec", F.col("modified_nano").cast("long").alias("modified_nano"), F.lit("PENDING").alias("state"))


def to_hash(jobs: DataFrame, when: str = "candidate") -> DataFrame:
    """Jobs with whether their content is to be hashed: always, never, or where another has their format and size."""
    same = F.count("*").over(Window.partitionBy("format", "size")) > 1
    return jobs.withColumn("hash", {"always": F.lit(True), "never": F.lit(False), "candidate": same}[when])


def set_fingerprint(components: list[dict], contents: bool) -> str:
    """Of one image's components in order: their shape, and with `contents` their digests too."""

    def utf(t: str) -> bytes:
        return struct.pack(">H", len(t.encode())) + t.encode()

    body = utf(CONTENT_TAG if contents else SHAPE_TAG) + struct.pack(">i", len(components))
    for c in components:
        body += struct.pack(">qq", c["ordinal"], c["parent_ordinal"]) + utf(c["role"]) + utf(c["format"]) + struct.pack(">q", c["size"])
        body += bytes.fromhex(c["sha256"]) if contents else b""
    return hashlib.sha256(body).hexdigest()


def fingerprints(components: DataFrame, image: str, contents: bool) -> DataFrame:
    """The same for each image of a table of components (`image` names whose they are), an image's few at a time."""
    columns = ["ordinal", "parent_ordinal", "role", "format", "size", *["sha256"] * contents]
    parts = components.groupBy(image).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("p"))

    def packed(body: Column, c: Column) -> Column:
        own = [packed_number(c["ordinal"], 16), packed_number(c["parent_ordinal"], 16), packed_text(c["role"]), packed_text(c["format"]), packed_number(c["size"], 16)]
        return F.concat(body, *own, *[F.unhex(c["sha256"])] * contents)

    head = F.concat(packed_text(F.lit(CONTENT_TAG if contents else SHAPE_TAG)), packed_number(F.size("p"), 8))
    return parts.select(image, F.sha2(F.aggregate("p", head, packed), 256).alias("fingerprint"))


def cached(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """For each (fingerprint, provider, policy) wanted the oldest complete result that can be used again."""
    fit = results.filter(F.col("reusable") & (F.col("state") == "COMPLETE"))
    keys = ["fingerprint", "provider", "policy"]
    return wanted.join(fit, keys).groupBy(*keys).agg(F.min(F.struct("completed_at", "result_id"))["result_id"].alias("result_id"))


def published(jobs: DataFrame, finished: DataFrame) -> DataFrame:
    """Jobs with the state and result of finished attempts (source key, state, result_id, duplicate, retryable)."""
    new = finished.select("scan_id", "source_id", *[F.col(c).alias(f"_{c}") for c in ("state", "result_id", "duplicate", "retryable")])
    out = jobs.join(new, ["scan_id", "source_id"], "left")
    for c in ("state", "result_id", "duplicate", "retryable"):
        out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c))).drop(f"_{c}")
    return out.select(*jobs.columns)


def status(inv: Inventory, name: str) -> DataFrame:
    """One row of counts; guest files of a result count once, however many jobs share it."""
    id_ = scan(inv, name)["scan_id"]
    phase = inv.image_runs.filter(F.col("scan_id") == id_).select("phase").limit(1).collect()
    own = inv.image_jobs.filter(F.col("scan_id") == id_)
    s = F.col("state")
    jobs = own.agg(
        F.count("*").alias("candidates"), F.count_if(s == "COMPLETE").alias("complete"), F.count_if(s == "PARTIAL").alias("partial"), F.count_if(s.isin("PENDING", "RUNNING")).alias("pending"),
        F.count_if(s == "COMPONENT").alias("component_files"), F.count_if("duplicate").alias("duplicates"), F.count_if((s == "PARTIAL") | F.col("diagnostic").isNotNull()).alias("errors"),
    )
    final = own.select("result_id").join(inv.image_results.filter(F.col("state").isin(*FINAL)), "result_id", "left_semi").distinct()
    hashed = F.col("sha256").isNotNull()
    guests = inv.image_entries.join(final, "result_id", "left_semi").agg(F.count("*").alias("entries"), F.count_if(hashed).alias("hashes_completed"), P.total(F.when(hashed, F.col("actual_size"))).alias("file_bytes"))
    return jobs.crossJoin(guests).select(F.lit(id_).cast("long").alias("scan_id"), F.lit(name).alias("name"), F.lit(phase[0][0] if phase else "NOT_STARTED").alias("phase"), "*")  # one row each


def listed(inv: Inventory, name: str) -> DataFrame:
    id_ = scan(inv, name)["scan_id"]
    facts = inv.image_results.filter(F.col("state").isin(*FINAL)).select("result_id", "fingerprint", "virtual_size", "provider", "summary_json")
    return inv.image_jobs.filter(F.col("scan_id") == id_).join(facts, "result_id", "left").orderBy("source_id")


def errors(inv: Inventory, name: str) -> DataFrame:
    id_ = scan(inv, name)["scan_id"]
    own = inv.image_jobs.filter(F.col("scan_id") == id_)
    final = own.join(inv.image_results.filter(F.col("state").isin(*FINAL)), "result_id", "left_semi").select("result_id", "relative_path")
    found = final.join(inv.image_errors, "result_id").select("relative_path", "result_id", "filesystem_id", "entry_id", "category", "code", "message")
    none = F.lit(None)
    failed = own.filter("diagnostic is not null").select("relative_path", none.cast("string").alias("result_id"), none.cast("long").alias("filesystem_id"), none.cast("long").alias("entry_id"), F.lit("OPERATIONAL").alias("category"), F.lit("JOB_FAILED").alias("code"), F.col("diagnostic").alias("message"))
    return found.unionByName(failed)


def detail(inv: Inventory, table: str, result_id: str) -> DataFrame:
    """Rows of a finished result: its image_components, image_partitions, image_filesystems or image_entries."""
    if table not in ("image_components", "image_partitions", "image_filesystems", "image_entries"):
        raise Refused(f"{table} has no rows of results", "NOT_FOUND")
    if inv.image_results.filter((F.col("result_id") == result_id) & F.col("state").isin(*FINAL)).isEmpty():
        raise Refused("no such result, or it is not finished", "NOT_FOUND")
    return getattr(inv, table).filter(F.col("result_id") == result_id)


def component_tree(inv: Inventory) -> DataFrame:
    """Each component with its parent's role."""
    parent = inv.image_components.select("result_id", F.col("ordinal").alias("parent_ordinal"), F.col("role").alias("parent_role"))
    return inv.image_components.join(parent, ["result_id", "parent_ordinal"], "left").select("result_id", "ordinal", "parent_ordinal", "role", "parent_role")


def resolved(root: str, needs: dict[str, list[str]], most: int = 256, deepest: int = 32) -> list[tuple[int, int, str]]:
    """(ordinal, parent, name) of an image and all it depends on, first needed first; refused for a cycle or over the bounds."""
    out: list[tuple[int, int, str]] = []

    def visit(name: str, parent: int, above: tuple[str, ...]) -> None:
        if name in above:
            raise InvalidInventory("an image depends on itself")
        if len(out) >= most or len(above) >= deepest:
            raise InvalidInventory("an image depends on too much")
        own = len(out)
        out.append((own, parent, name))
        for other in needs.get(name, []):
            visit(other, own, (*above, name))

    visit(root, -1, ())
    return out

"""Predicates of a file request as columns over observations (see `observations`)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvault.errors import Refused
from tallyvault.functions import paths, text
from tallyvault.inventory import Inventory

HUGE = "decimal(38,0)"


def total(column: Column) -> Column:
    """A sum that cannot overflow, as exact text; 0 over nothing."""
    return F.coalesce(F.sum(column.cast(HUGE)), F.lit(0).cast(HUGE)).cast("string")


def every(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def scoped(df: DataFrame, scan_ids: list[int]) -> DataFrame:
    """Only the selected scans; all of them where none is selected."""
    return df.filter(F.col("scan_id").isin(scan_ids)) if scan_ids else df


def observations(inv: Inventory, scan_ids: list[int], errors: bool = True) -> DataFrame:
    """Entries of the selected scans with sha256 (null: not hashed) and, if wanted, has_error."""
    rows = scoped(inv.entries, scan_ids).join(scoped(inv.hashes, scan_ids), ["scan_id", "entry_id"], "left")
    if not errors:
        return rows
    failed = scoped(inv.scan_errors, scan_ids).select("scan_id", "relative_path").distinct().withColumn("has_error", F.lit(True))
    return rows.join(failed, ["scan_id", "relative_path"], "left").withColumn("has_error", F.coalesce("has_error", F.lit(False)))


def copies(hashed: DataFrame) -> DataFrame:
    """copies and scan_copies of each content, among the given observations."""
    files = hashed.filter("kind = 'FILE' and sha256 is not null")
    return files.groupBy("size", "sha256").agg(F.count("*").alias("copies"), F.count_distinct("scan_id").alias("scan_copies"))


def directory(inv: Inventory, where: dict) -> Column:
    """In or directly in a directory; the directory itself is not in it."""
    found = inv.entries.filter((F.col("scan_id") == where["scan_id"]) & (F.col("entry_id") == where["entry_id"]) & (F.col("kind") == "DIRECTORY")).select("relative_path").limit(1).collect()
    if not found:
        raise Refused("no such directory", "ENTRY_NOT_FOUND")
    own = F.col("scan_id") == where["scan_id"]
    if not where["recursive"]:
        return own & (F.col("parent_id") == where["entry_id"])
    prefix = found[0][0] + "/" if found[0][0] else ""
    return own & F.col("relative_path").startswith(prefix) & (F.col("entry_id") != where["entry_id"])


def _range(column: Column, wanted: dict) -> list[Column]:
    return [test for key, test in (("exact", column.__eq__), ("min", column.__ge__), ("max", column.__le__)) if wanted[key] is not None for test in [test(wanted[key])]]


def content(inv: Inventory, spec: dict, duplicates: str | None = None) -> Column:
    """All predicates of a normal request on one observation; `duplicates` needs copies and scan_copies."""
    path, name = F.col("relative_path"), F.col("filename")
    tests = [F.col("kind").isin(spec["kinds"])]
    if spec["directory"]:
        tests.append(directory(inv, spec["directory"]))
    if spec["name"]:
        tests.append(text.named(name, spec["name"]["value"], spec["name"]["match"], spec["name"]["case_sensitive"]))
    if spec["path"]["contains"]:
        tests.append(path.contains(spec["path"]["contains"]))
    if spec["path"]["starts_with"]:
        tests.append(path.startswith(spec["path"]["starts_with"]))
    if spec["path"]["under"]:
        tests.append(paths.under(path, spec["path"]["under"]))
    tests += [~paths.under(path, p) for p in spec["path"]["excludes"]]
    if spec["extensions"]:
        tests.append(reduce(lambda a, b: a | b, [F.lower(name).endswith("." + e) for e in spec["extensions"]]))
    tests += _range(F.col("size"), spec["size"]) + _range(F.col("modified_sec"), spec["modified"])
    if spec["hash_state"] != "ANY":
        tests.append(F.col("sha256").isNotNull() if spec["hash_state"] == "HASHED" else F.col("sha256").isNull())
    if spec["error_state"] != "ANY":
        tests.append(F.col("has_error") if spec["error_state"] == "HAS" else ~F.col("has_error"))
    if duplicates not in (None, "ANY"):
        n, across = F.coalesce("copies", F.lit(0)), F.coalesce("scan_copies", F.lit(0))
        tests.append({"CONFIRMED": n >= 2, "COPIES_2": n >= 2, "COPIES_3": n >= 3, "ACROSS_SCANS": across >= 2, "NOT_CONFIRMED": n < 2}[duplicates])
    return every(tests)

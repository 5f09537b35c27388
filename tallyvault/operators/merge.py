"""Taking a whole inventory into another: new ids, every row, checked row by row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvault.errors import Refused
from tallyvault.inventory import Inventory, Store
from tallyvault.operators import audit
from tallyvault.schemas import ARCHIVE, BASE, IMAGE, SCHEMAS

_RESULTS = ("result_id", "parent_result_id", "child_result_id")


def conflicts(source: Inventory, destination: Inventory) -> DataFrame:
    """Names that scans of both inventories have."""
    return source.scans.select("name").join(destination.scans.select("name"), "name", "left_semi").orderBy("name")


def scan_map(source: Inventory, destination: Inventory) -> DataFrame:
    """old_scan_id, new_scan_id, name: ids after the destination's last, in order, none equal to its old one.

    Scans, not entries, are numbered here: a few rows, by the driver.
    """
    last = destination.scans.agg(F.coalesce(F.max("scan_id"), F.lit(0))).first()[0]
    rows = []
    for r in source.scans.select("scan_id", "name").orderBy("scan_id").toLocalIterator():
        last += 2 if last + 1 == r["scan_id"] else 1
        rows.append((r["scan_id"], last, r["name"]))
    if last >= 1 << 63:
        raise Refused("there are no more scan ids", "SCAN_ID_EXHAUSTED")
    return source.spark.createDataFrame(rows, "old_scan_id long, new_scan_id long, name string")


def result_map(source: Inventory, destination: Inventory, feature: str, salt: str) -> DataFrame:
    """old_result_id, new_result_id: ids drawn from the old ones and a salt, again for any that is taken."""
    old = getattr(source, f"{feature}_results").select(F.col("result_id").alias("old_result_id")).distinct()
    taken = old.select(F.col("old_result_id").alias("new_result_id")).unionByName(getattr(destination, f"{feature}_results").select(F.col("result_id").alias("new_result_id")))

    def drawn(rows: DataFrame, turn: int) -> DataFrame:
        h = F.md5(F.concat_ws("/", F.lit(salt), F.lit(turn), "old_result_id"))
        parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return rows.select("old_result_id", F.concat_ws("-", *parts).alias("new_result_id"))

    made = drawn(old, 0)
    for turn in range(1, 64):
        used = made.join(taken, "new_result_id", "left_semi").select("old_result_id")
        if used.isEmpty():
            return made
        made = made.join(used, "old_result_id", "left_anti").unionByName(drawn(used, turn))
    raise Refused("no free result ids were found", "RESULT_MAP_INCOMPLETE")


def projected(table: DataFrame, scans: DataFrame, results: DataFrame | None) -> DataFrame:
    """A table's rows with the ids of the destination; scans are few, so their map is broadcast."""
    out = table
    if "scan_id" in table.columns:
        ids = F.broadcast(scans.select(F.col("old_scan_id").alias("scan_id"), F.col("new_scan_id").alias("_scan")))
        out = out.join(ids, "scan_id").withColumn("scan_id", F.col("_scan")).drop("_scan")
    for c in _RESULTS:
        if c in table.columns and results is not None:
            out = out.join(results.select(F.col("old_result_id").alias(c), F.col("new_result_id").alias(f"_{c}")), c, "left").withColumn(c, F.col(f"_{c}")).drop(f"_{c}")
    return out.select(*table.columns)


def imported(table: DataFrame, scans: DataFrame, results: DataFrame | None) -> DataFrame:
    """Of a merged table the rows that came in."""
    if "scan_id" in table.columns:
        return table.join(F.broadcast(scans.select(F.col("new_scan_id").alias("scan_id"))), "scan_id", "left_semi").select(*table.columns)
    key = next(c for c in ("parent_result_id", "result_id") if c in table.columns)
    return table.join(results.select(F.col("new_result_id").alias(key)), key, "left_semi").select(*table.columns)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two tables has more often than the other, with the side that has them."""
    left, right = a.exceptAll(b.select(*a.columns)), b.select(*a.columns).exceptAll(a)
    return left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right")))


def row_counts(source: Inventory, tables: list[str]) -> DataFrame:
    """name and n: the rows of each table."""
    return reduce(DataFrame.unionByName, [getattr(source, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in tables])


def merge(source: Inventory, store: Store, dry_run: bool = False, salt: str = "merge") -> dict:
    """Audit both, map ids, copy every table, check each copy as a multiset, audit again, publish at once."""
    destination = store.load()
    audit.require(source)
    audit.require(destination)
    if names := [r[0] for r in conflicts(source, destination).limit(1000).collect()]:
        raise Refused(f"scan names are in both: {names}", "SCAN_NAME_CONFLICT")
    scans = scan_map(source, destination).persist()
    results = {f: result_map(source, destination, f, salt).persist() for f in ("archive", "image") if f in source.features()}
    tables = [*BASE, *(ARCHIVE if "archive" in results else ()), *(IMAGE if "image" in results else ())]
    rows = {r["name"]: r["n"] for r in row_counts(source, tables).collect()}
    ids = scans.agg(F.min("new_scan_id"), F.max("new_scan_id")).first()
    out = {"status": "READY" if dry_run else "IMPORTED", "dry_run": dry_run, "rows": rows, "new_scan_id_first": ids[0], "new_scan_id_last": ids[1], "features_to_initialize": sorted(source.features() - destination.features())}
    if rows["scans"] == 0:
        return out | {"status": "NO_SCANS"}
    if dry_run:
        return out
    merged, came = {}, {}
    for t in tables:
        came[t] = copy = projected(getattr(source, t).select(*SCHEMAS[t].names), scans, results.get(t.split("_")[0]))
        merged[t] = getattr(destination, t).unionByName(copy)
        if not differences(copy, imported(merged[t], scans, results.get(t.split("_")[0]))).isEmpty():
            raise Refused(f"{t} was not copied as it is", "ROW_CONTENT_MISMATCH")
    audit.require(destination.with_tables(**merged))
    store.save(append=True, base=destination.revision, **came)  # what was there is not written again
    return out

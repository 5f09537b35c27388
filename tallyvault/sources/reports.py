"""Reports as files: JSON lines or text, written by many tasks, whose parts in the order of their names are the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(rows: DataFrame, folder: str) -> None:
    """One JSON object a row, nulls included; rows that are sorted stay so over the parts."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(folder)


def line_of(row: dict, named: bool) -> tuple[str, str]:
    """A group's heading and a path's line, as `grouped` writes them; for printing."""
    if named:
        return f"{row['copies']} copies in {row['scan_count']} scans, {row['size']} bytes, {row['sha256']}", f"  [{row['scan_name']}] {row['path']}"
    return f"{row['copies']} copies, {row['size']} bytes, {row['sha256']}", f"  {row['path']}"


def grouped(rows: DataFrame, folder: str, order: list[str]) -> None:
    """A heading for each content and its paths below, largest contents first, paths by `order`.

    Headings are rows of their own that sort before their paths, so a content may lie in
    any number of parts and still has one.
    """
    named = "scan_name" in rows.columns
    count = [F.col("copies").cast("string"), F.lit(" copies")] + [F.lit(" in "), F.col("scan_count").cast("string"), F.lit(" scans")] * named
    heading = F.concat(*count, F.lit(", "), F.col("size").cast("string"), F.lit(" bytes, "), F.col("sha256"))
    path = F.concat(F.lit("  ["), F.col("scan_name"), F.lit("] "), F.col("path")) if named else F.concat(F.lit("  "), F.col("path"))

    def placed(line: Column, rank: int) -> list[Column]:
        keys = [F.col(c) if rank else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order]
        return [F.col("size"), F.col("sha256"), F.lit(rank).alias("_rank"), *keys, line.alias("value")]

    heads = rows.groupBy("size", "sha256").agg(*[F.max(c).alias(c) for c in ("copies", *["scan_count"] * named)]).select(*placed(heading, 0))
    both = heads.unionByName(rows.select(*placed(path, 1)))
    both.orderBy(F.desc("size"), "sha256", "_rank", *order).select("value").write.text(folder)

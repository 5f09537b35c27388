"""Command line over a store: `python -m tallyvault.cli --store FOLDER COMMAND ...`.

Exit codes: 0 done, 1 failed or refused, 2 wrong usage, 3 done with recorded errors or a
partial report; a merge gives 3 for a refusal and 4 for an inconsistent inventory.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Iterator
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvault.errors import InvalidInventory, Refused
from tallyvault.inventory import Inventory, Store, scan
from tallyvault.operators import archives, browse, candidates, duplicates, images, merge
from tallyvault.schemas import SCHEMAS
from tallyvault.sources import archive_files, archive_run, hashing, image_run, reports
from tallyvault.sources.discovery import begun, loaded, resumed, walked
from tallyvault.storage import settle

OK, FAILED, USAGE, PARTIAL, INCONSISTENT = 0, 1, 2, 3, 4
LIMITS = {k.replace("_", "-"): v for k, v in asdict(archive_files.Limits()).items()}


def lines(df: DataFrame) -> Iterator[str]:
    """JSON objects in the frame's order, a partition at a time."""
    for row in df.toLocalIterator():
        yield json.dumps(row.asDict(), default=str, ensure_ascii=False)


def grouped(df: DataFrame) -> Iterator[str]:
    """A heading for each content and its paths below."""
    last, named = None, "scan_name" in df.columns
    for r in df.toLocalIterator():
        heading, line = reports.line_of(r.asDict(), named)
        if (r["size"], r["sha256"]) != last:
            last = (r["size"], r["sha256"])
            yield heading
        yield line


def cross_hashed(store: Store, names: list[str]) -> int:
    """Hash what the comparison of scans lacks: files of sizes that two or more of them have; how many could not be read."""
    inv = loaded(store)
    missing = candidates.cross_candidates(inv, candidates.selected(inv, names)).filter("sha256 is null").select("scan_id", "entry_id")
    files = settle(inv.entries.join(missing, ["scan_id", "entry_id"], "left_semi"))
    if files.isEmpty():
        return 0
    new, errors = (settle(df) for df in hashing.hashed(files, inv.scans))
    store.save(append=True, base=inv.revision, hashes=new, scan_errors=errors)
    return errors.count()


def imaged(store: Store, args: argparse.Namespace) -> int:
    """Analyse images with a provider that is named as `module:attribute`; it is called without arguments if it is a class or function."""
    module, _, attribute = args.provider.partition(":")
    try:
        provider = getattr(importlib.import_module(module), attribute)
    except (ImportError, AttributeError, ValueError) as e:
        raise Refused(f"no provider {args.provider!r}: {e}", "CAPABILITY") from e
    provider = provider() if callable(provider) else provider
    return OK if image_run.publish(store, args.name, provider, args.provider, when=args.container_hash) == "COMPLETE" else PARTIAL


def hashed(store: Store, name: str, rehash: bool, complete: bool) -> int:
    inv = loaded(store)
    own = scan(inv, name)
    id_ = own["scan_id"]
    mine = F.col("scan_id") == id_
    new, errors = hashing.hashed(candidates.to_hash(inv, id_, rehash, complete), inv.scans)
    failed = inv.scan_errors.filter(mine & (F.col("phase") != "HASHING")).unionByName(errors)
    some = not failed.isEmpty()
    own |= {"phase": "COMPLETE_WITH_ERRORS" if some else "COMPLETE", "updated_at": datetime.now(timezone.utc)}
    head = store.spark.createDataFrame([tuple(own[c] for c in SCHEMAS["scans"].names)], SCHEMAS["scans"])
    store.save(scan=id_, base=inv.revision, scans=head, hashes=candidates.upserted(inv.hashes.filter(mine), new), scan_errors=failed)
    return PARTIAL if some else OK


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallyvault")
    top.add_argument("--store", required=True)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *flags: tuple[str, dict]) -> None:
        one = commands.add_parser(name)
        for flag, more in flags:
            one.add_argument(flag, **more)

    named, yes = ("--name", {"required": True}), {"action": "store_true"}
    result = ("--result", {"required": True})
    add("scan", named, ("--root", {"required": True}), ("--discover-only", yes))
    for c in ("hash", "resume"):
        add(c, named, ("--rehash", yes), ("--hash-complete", yes), *[("--discover-only", yes)] * (c == "resume"))
    add("archives", named, *[(f"--{flag}", {"type": int, "default": default}) for flag, default in LIMITS.items()])
    add("images", named, ("--provider", {"required": True}), ("--container-hash", {"choices": ["candidate", "always", "never"], "default": "candidate"}))
    add("list")
    for c in ("status", "errors", "archive-status", "archive-list", "archive-errors", "image-status", "image-list", "image-errors"):
        add(c, named)
    output = ("--output", {"help": "a new folder that the report is written to, in parts that follow each other"})
    add("duplicates", named, ("--format", {"choices": ["text", "jsonl"], "default": "text"}), ("--allow-partial", yes), output)
    add("cross-duplicates", ("--scan", {"action": "append", "required": True}), ("--format", {"choices": ["table", "text", "jsonl"], "default": "table"}), output)
    for c in ("archive-entries", "archive-volumes", "image-entries", "image-filesystems", "image-partitions", "image-components"):
        add(c, result)
    add("merge-database", ("--source", {"required": True}), ("--dry-run", yes), ("--quiet", yes))
    return top


def run(spark: SparkSession, argv: list[str], out=print, err=lambda line: print(line, file=sys.stderr)) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else OK
    store = Store(spark, args.store)
    shown = {
        "list": lambda inv: inv.scans.orderBy("scan_id"), "status": lambda inv: duplicates.status(inv, args.name), "errors": lambda inv: browse.all_errors(inv, scan(inv, args.name)["scan_id"]),
        "archive-status": lambda inv: archives.status(inv, args.name), "archive-list": lambda inv: archives.listed(inv, args.name), "archive-errors": lambda inv: archives.errors(inv, args.name),
        "image-status": lambda inv: images.status(inv, args.name), "image-list": lambda inv: images.listed(inv, args.name), "image-errors": lambda inv: images.errors(inv, args.name),
        "archive-entries": lambda inv: archives.members(inv, args.result), "archive-volumes": lambda inv: archives.volumes(inv, args.result),
    }
    try:
        if args.command == "scan":
            begun(store, args.name, args.root)
            walked(store, args.name)
            return OK if args.discover_only else hashed(store, args.name, False, False)
        if args.command in ("hash", "resume"):
            if args.command == "resume":
                resumed(store, args.name)
                if args.discover_only:
                    return OK
            return hashed(store, args.name, args.rehash, args.hash_complete)
        if args.command == "archives":
            chosen = archive_files.Limits(**{k.replace("-", "_"): getattr(args, k.replace("-", "_")) for k in LIMITS})
            return OK if archive_run.publish(store, args.name, chosen) == "COMPLETE" else PARTIAL
        if args.command == "images":
            return imaged(store, args)
        if args.command == "cross-duplicates":
            cross_hashed(store, args.scan)
        if args.command == "merge-database":
            try:
                if not args.quiet:
                    err(json.dumps({"event": "merge", "source": args.source, "dry_run": args.dry_run}))
                out(json.dumps(merge.merge(store_inventory(spark, args.source), store, args.dry_run), default=str))
                return OK
            except InvalidInventory as e:
                out(json.dumps(e.body()))
                return INCONSISTENT
            except Refused as e:
                out(json.dumps(e.body()))
                return PARTIAL
        inv, partial = loaded(store), False
        if args.command == "duplicates":
            rows = duplicates.report(inv, args.name, args.allow_partial)
            partial = scan(inv, args.name)["phase"] != "COMPLETE"
        elif args.command == "cross-duplicates":
            rows = duplicates.cross_report(inv, args.scan)
            summary = duplicates.cross_summary(inv, args.scan)
            partial = summary["partial"]
            err(json.dumps({"event": "cross_scan_summary"} | summary, default=str))
        elif args.command in shown:
            rows = shown[args.command](inv)
        else:
            rows = images.detail(inv, args.command.replace("-", "_"), args.result)
        text = getattr(args, "format", "jsonl") in ("text", "table")
        if getattr(args, "output", None):
            order = ["relative_path"] if args.command == "duplicates" else ["scan_ordinal", "relative_path", "entry_id"]
            reports.grouped(rows, args.output, order) if text else reports.json_lines(rows, args.output)
            return PARTIAL if partial else OK
        for line in grouped(rows) if text else lines(rows):
            out(line)
        return PARTIAL if partial else OK
    except Refused as e:
        out(json.dumps(e.body()))
        return FAILED


def store_inventory(spark: SparkSession, folder: str) -> Inventory:
    return loaded(Store(spark, folder))


def main() -> None:
    spark = SparkSession.builder.appName("tallyvault").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        code = run(spark, sys.argv[1:])
    finally:
        spark.stop()
    sys.exit(code)


if __name__ == "__main__":
    main()

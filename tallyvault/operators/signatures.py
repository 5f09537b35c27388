"""Saved contents and saved searches, and where they are found again."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvault import cursor, spec
from tallyvault.errors import InvalidFilter, Refused
from tallyvault.functions import paths
from tallyvault.inventory import Inventory
from tallyvault.schemas import SCHEMAS
from tallyvault.storage import settle

MOST_TAG, MOST_MEMO, MOST_SEARCHES = 120, 4000, 500


def matches(inv: Inventory, signature: str, position: list | None = None, limit: int | None = None) -> DataFrame:
    """A page of the files of all scans that have a signature's content, single ones too."""
    found = inv.signatures.filter(F.col("id") == signature).select("size", "sha256", "algorithm").limit(1).collect()
    if not found:
        raise Refused("no such signature", "NOT_FOUND")
    own = (F.col("size") == found[0]["size"]) & (F.col("sha256") == found[0]["sha256"])
    files = inv.entries.filter("kind = 'FILE'").filter(F.col("size") == found[0]["size"]).join(inv.hashes, ["scan_id", "entry_id"]).filter(own)
    named = files.join(F.broadcast(inv.scans.filter(F.col("algorithm") == found[0]["algorithm"]).select("scan_id", "name", "root")), "scan_id")
    shown = named.select("scan_id", F.col("name").alias("scan_name"), "entry_id", "relative_path", paths.joined(F.col("root"), F.col("relative_path")).alias("path"), "size", "sha256")
    return cursor.page(shown, [(F.col("scan_id"), False), (F.col("entry_id"), False)], spec.page_size(limit), position)


def decorated(page: DataFrame, signatures: DataFrame) -> DataFrame:
    """Rows of a page, a few hundred at most, with the signature of their content, if there is one."""
    known = signatures.select("size", "sha256", F.col("id").alias("signature_id"), F.col("tag").alias("signature_tag"))
    wanted = F.broadcast(page.select("size", "sha256").filter("sha256 is not null").distinct())
    return page.join(F.broadcast(known.join(wanted, ["size", "sha256"], "left_semi")), ["size", "sha256"], "left")


def counts(inv: Inventory) -> DataFrame:
    """How many files, and of how many scans, each signature has."""
    files = inv.entries.filter("kind = 'FILE'").join(inv.hashes, ["scan_id", "entry_id"])
    found = files.join(inv.signatures.select("id", "size", "sha256"), ["size", "sha256"])
    return found.groupBy("id").agg(F.count("*").alias("files"), F.count_distinct("scan_id").alias("scans"))


def listed(inv: Inventory, limit: int | None = None, position: list | None = None) -> DataFrame:
    """A page of the signatures by tag, with how many files of how many scans have each page row's content."""
    keyed = inv.signatures.withColumn("sort_key", F.lower("tag"))
    rows = settle(cursor.page(keyed, [(F.col(c), False) for c in ("sort_key", "tag", "id")], spec.page_size(limit), position))
    found = counts(inv.with_tables(signatures=rows.drop("sort_key")))
    shown = rows.join(F.broadcast(found), "id", "left").fillna(0, ["files", "scans"])
    return shown.select("id", "algorithm", "size", "sha256", "tag", "memo", "files", "scans", "sort_key").orderBy("sort_key", "tag", "id")


def get(table: DataFrame, id_: str) -> dict:
    """One signature or saved search."""
    found = table.filter(F.col("id") == id_).limit(1).collect()
    if not found:
        raise Refused("nothing has this id", "NOT_FOUND")
    return found[0].asDict()


def _described(tag: str, memo: str) -> None:
    if not tag.strip() or len(tag) > MOST_TAG or len(memo) > MOST_MEMO:
        raise InvalidFilter("the tag or the memo cannot be used")


def _replaced(table: DataFrame, row: dict, name: str) -> DataFrame:
    one = table.sparkSession.createDataFrame([tuple(row[c] for c in SCHEMAS[name].names)], SCHEMAS[name])
    return table.filter(F.col("id") != row["id"]).select(*SCHEMAS[name].names).unionByName(one)


def updated(inv: Inventory, id_: str, tag: str | None = None, memo: str | None = None) -> DataFrame:
    """The signatures with another tag or memo for one; its content stays what it is."""
    row = get(inv.signatures, id_)
    row |= {"tag": row["tag"] if tag is None else tag, "memo": row["memo"] if memo is None else memo, "updated_at": datetime.now(timezone.utc)}
    _described(row["tag"], row["memo"])
    return _replaced(inv.signatures, row, "signatures")


def created(inv: Inventory, scan_id: int, entry_id: int, tag: str, memo: str = "") -> DataFrame:
    """The signatures with one more, of a hashed file."""
    _described(tag, memo)
    own = (F.col("scan_id") == scan_id) & (F.col("entry_id") == entry_id)
    found = inv.entries.filter(own & (F.col("kind") == "FILE")).join(inv.hashes, ["scan_id", "entry_id"], "left").select("size", "sha256").collect()
    if not found:
        raise Refused("no such file", "ENTRY_NOT_FOUND")
    size, digest = found[0]
    if digest is None:
        raise Refused("the file has no digest", "HASH_UNAVAILABLE")
    if not inv.signatures.filter((F.col("size") == size) & (F.col("sha256") == digest)).isEmpty():
        raise Refused("the content has a signature", "SIGNATURE_EXISTS")
    now = datetime.now(timezone.utc)
    one = inv.spark.createDataFrame([(str(uuid.uuid4()), "SHA-256", size, digest, tag, memo, now, now)], SCHEMAS["signatures"])
    return inv.signatures.unionByName(one)


def saved_search(inv: Inventory, scanner_path: str, name: str, request: dict, description: str = "") -> DataFrame:
    """The saved searches with one more; the request is stored in its normal form."""
    taken = inv.saved_searches.filter((F.col("scanner_path") == scanner_path) & (F.col("name") == name))
    if not taken.isEmpty():
        raise Refused("a search has this name", "SAVED_SEARCH_EXISTS")
    now = datetime.now(timezone.utc)
    body = json.dumps(spec.file_search(request), sort_keys=True)
    return inv.saved_searches.unionByName(inv.spark.createDataFrame([(str(uuid.uuid4()), scanner_path, name, description, body, now, now)], SCHEMAS["saved_searches"]))


def updated_search(inv: Inventory, id_: str, name: str | None = None, request: dict | None = None, description: str | None = None) -> DataFrame:
    """The saved searches with one changed; another search of its path must not have the name."""
    row = get(inv.saved_searches, id_)
    row |= {k: v for k, v in (("name", name), ("description", description)) if v is not None} | {"updated_at": datetime.now(timezone.utc)}
    if request is not None:
        row["request_json"] = json.dumps(spec.file_search(request), sort_keys=True)
    same = (F.col("scanner_path") == row["scanner_path"]) & (F.col("name") == row["name"]) & (F.col("id") != id_)
    if not inv.saved_searches.filter(same).isEmpty():
        raise Refused("a search has this name", "SAVED_SEARCH_EXISTS")
    return _replaced(inv.saved_searches, row, "saved_searches")


def saved_searches(inv: Inventory, scanner_path: str) -> DataFrame:
    own = inv.saved_searches.filter(F.col("scanner_path") == scanner_path)
    return own.orderBy(F.lower("name"), "name", "id").limit(MOST_SEARCHES + 1)


def without(table: DataFrame, id_: str) -> DataFrame:
    if table.filter(F.col("id") == id_).isEmpty():
        raise Refused("nothing has this id", "NOT_FOUND")
    return table.filter(F.col("id") != id_)

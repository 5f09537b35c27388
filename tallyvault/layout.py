"""Scans whose files are sorted by path, and searches that open only files that can hold a match.

`clustered` writes a scan's entries and digests anew, in files of adjacent paths, and with
them a table of zones (a row a file: the bounds of its paths) and one of grams (the hashed
trigrams of each file's names).  A search takes from the zones what a prefix, a subtree or a
cursor allows, from the grams what holds the trigrams of a name, and puts the exact
predicates to what is left.  Rows that were added later have no zones and are always read.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvault import spec
from tallyvault.inventory import Inventory, Store
from tallyvault.operators import contents, search
from tallyvault.operators import predicates as P
from tallyvault.schemas import STORED

#: Rows of a file, about.
FILE_ROWS = 1_000_000
#: Values that trigrams are hashed to; a file has at most so many.
GRAMS = 1 << 14
#: Files that a search by path opens first; each further step opens STEP times as many.
FIRST, STEP = 4, 4
#: Files that are named one by one; a search that needs more reads its scans as they are.
MOST_FILES = 4_096
#: Trigrams of a request that are looked up.
MOST_GRAMS = 64


def _key() -> Column:
    return F.lower("relative_path")


def _grams() -> Column:
    """Hashed trigrams of ASCII characters in a path and a name, in lower case."""
    chars = F.split(F.concat_ws("\n", _key(), F.lower("filename")), "")
    starts = F.sequence(F.lit(1), F.greatest(F.size(chars) - 2, F.lit(1)))
    triples = F.transform(starts, lambda i: F.concat(*[F.coalesce(F.get(chars, i - 1 + k), F.lit("")) for k in range(3)]))
    plain = F.filter(F.array_distinct(triples), lambda g: g.rlike(r"\A[\x00-\x7f]{3}\z"))
    return F.transform(plain, lambda g: (F.crc32(g) % GRAMS).cast("int"))


def clustered(store: Store, scan_ids: list[int], file_rows: int = FILE_ROWS) -> int:
    """Sort scans' entries and digests by path, in files of about so many rows; rows stay as they are."""
    inv, generation = store.load(), uuid.uuid4().hex
    mine = F.col("scan_id").isin(scan_ids)
    entries = inv.entries.filter(mine)
    ways = entries.select("scan_id", "entry_id", "relative_path")
    order = ["scan_id", _key(), "relative_path", "entry_id"]
    pieces = entries.count() // file_rows + 1
    # a digest without an entry stays, with no path
    with_path = inv.hashes.filter(mine).join(ways, ["scan_id", "entry_id"], "left")
    new, zones = {}, []
    for name, rows in (("entries", entries), ("hashes", with_path)):
        ordered = rows.repartitionByRange(pieces, *order).sortWithinPartitions(*order)
        new[name] = store.write(name, ordered.select(*STORED[name].names), generation)
        back = store.files(name, [(s, generation, "") for s in new[name]], "_metadata.file_name")
        told = back if name == "entries" else back.join(ways, ["scan_id", "entry_id"], "left")
        zones.append(told.groupBy("scan_id", F.lit(name).alias("of"), F.lit(generation).alias("written"), "file").agg(F.count("*").alias("rows"), *_bounds()))
        if name == "entries":
            grams = back.select("scan_id", F.lit(generation).alias("written"), "file", F.explode(_grams()).alias("gram")).distinct()
    new["zones"] = store.write("zones", zones[0].unionByName(zones[1]), generation)
    new["grams"] = store.write("grams", grams.repartitionByRange("scan_id", "gram").sortWithinPartitions("scan_id", "gram"), generation)
    return store.publish([(name, str(s), False) for name in new for s in scan_ids], new, generation, inv.revision, same=True)


def _bounds() -> list[Column]:
    """Of a file's paths; none if one of its rows has no path."""
    path, whole = F.col("relative_path"), F.count("relative_path") == F.count("*")
    return [F.when(whole, told).alias(name) for name, told in (("least", F.min(path)), ("most", F.max(path)), ("least_key", F.min(_key())), ("most_key", F.max(_key())))]


def _runs(pattern: str) -> list[str]:
    """Texts that every match of a regular expression or glob has; none for what is not plainly a sequence."""
    if any(c in pattern for c in "|([{#"):
        return []
    out, run, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            c = pattern[i + 1 : i + 2]
            if c.isalnum() and c not in "dDwWsSbB":
                return []
            if c.isalnum():
                out, run = [*out, run], ""
            else:
                run += c
            i += 2
            continue
        if c in "*?":
            run = run[:-1]
        if c in "*?+.^$":
            out, run = [*out, run], ""
        else:
            run += c
        i += 1
    return [*out, run]


def wanted_grams(wanted: dict) -> list[int]:
    """Trigrams that the names of all matches of a normal request have.

    They are of ASCII characters, whose lower case hangs on nothing else.  Patterns without
    case take some other letters for i, k and s, so these are left out there.
    """
    runs: list[tuple[str, str]] = []
    if name := wanted["name"]:
        regular = name["match"] in ("REGEX", "GLOB")
        found = _runs(name["value"]) if name["match"] == "REGEX" else name["value"].replace("?", "*").split("*") if regular else [name["value"]]
        runs += [(r, "iks" if regular and not name["case_sensitive"] else "") for r in found]
    runs += [(wanted["path"][k], "") for k in ("contains", "starts_with", "under") if wanted["path"][k]]
    if len(wanted["extensions"]) == 1:
        runs.append(("." + wanted["extensions"][0], ""))
    out = set()
    for run, without in runs:
        triples = [run[i : i + 3].lower() for i in range(len(run) - 2) if run[i : i + 3].isascii()]
        out |= {g for g in triples if not set(g) & set(without)}
    return sorted({zlib.crc32(g.encode()) % GRAMS for g in out})[:MOST_GRAMS]


def _starting(prefix: str) -> Column:
    """Zones that can hold a path that starts with a prefix: their bounds are on both sides of it, or within."""
    return (F.col("most") >= prefix) & ((F.col("least") <= prefix) | F.col("least").startswith(prefix))


@dataclass
class Chosen:
    """Files of a table that a search needs: (scan, generation, name), an empty name for all of a generation."""

    zones: DataFrame
    loose: list[tuple[str, str, str]]


def _live(store: Store, revision: int, table: str, scan_ids: list[int]) -> Chosen:
    """Zones of the generations that count now, and the generations that have none."""
    live = store.manifest(revision)["tables"]
    named = {(s, g) for s, generations in live.get(table, {}).items() if not scan_ids or int(s) in scan_ids for g in generations}
    pairs = store.spark.createDataFrame(sorted((int(s), g) for s, g in named), "scan_id long, written string")
    zones = P.scoped(store.stored("zones", revision), scan_ids).filter(F.col("of") == table).join(F.broadcast(pairs), ["scan_id", "written"], "left_semi")
    having = {(str(r["scan_id"]), r["written"]) for r in zones.select("scan_id", "written").distinct().collect()}  # one a scan, or few
    return Chosen(zones, [(s, g, "") for s, g in sorted(named - having)])


def _overlapping(zones: list, chosen: list) -> list:
    """Those zones whose paths meet the paths of chosen ones, by scan."""
    spans: dict[int, list] = {}
    for z in sorted(chosen, key=lambda z: (z["scan_id"], z["least_key"])):
        own = spans.setdefault(z["scan_id"], [])
        if own and z["least_key"] <= own[-1][1]:
            own[-1][1] = max(own[-1][1], z["most_key"])
        else:
            own.append([z["least_key"], z["most_key"]])
    out = []
    for z in zones:
        own = spans.get(z["scan_id"], [])
        at = bisect_left([most for _, most in own], z["least_key"] or "")
        if z["least_key"] is None or (at < len(own) and own[at][0] <= z["most_key"]):
            out.append(z)
    return out


def _place(z) -> tuple[str, str, str]:
    return str(z["scan_id"]), z["written"], z["file"]


def _directory(store: Store, inv: Inventory, zones: DataFrame, where: dict) -> tuple[str | None, Inventory]:
    """A directory's path, and an inventory with what can hold its entry; the whole one where its path is not known."""
    own = (F.col("scan_id") == where["scan_id"]) & (F.col("entry_id") == where["entry_id"])
    found = inv.directories.filter(own).select("relative_path").limit(1).collect()
    if not found:
        return None, inv
    path = found[0][0]
    at = zones.filter((F.col("scan_id") == where["scan_id"]) & (F.col("least") <= path) & (F.col("most") >= path)).limit(MOST_FILES).collect()
    few = inv.with_tables(entries=store.files("entries", list(map(_place, at))))
    known = few.entries.filter(own & (F.col("kind") == "DIRECTORY") & (F.col("relative_path") == path))
    return (path, few) if not known.isEmpty() else (None, inv)


def page(store: Store, request: dict, position: list | None = None) -> DataFrame:
    """A page of a search and one row more, as `search.page` gives it, from the files that it needs.

    By path, files are opened in the order of their bounds, a few and then more, until no
    other file can hold a row of the page; else, all files that can hold a match.  Requests
    for copies, and those that need more than MOST_FILES files, read their scans whole.
    """
    return searched(store, request, position)[0]


def searched(store: Store, request: dict, position: list | None = None) -> tuple[DataFrame, int | None]:
    """The page, and how many files of entries were opened for it; none if scans were read whole."""
    inv, wanted = store.load(), spec.file_search(request)
    if wanted["duplicate_state"] not in (None, "ANY"):
        return search.page(inv, request, position), None
    if not set(wanted["scan_ids"] or map(int, store.manifest(inv.revision)["tables"].get("hashes", {}))) & set(contents.missing(store, inv.revision)):
        inv.contents = store.stored("contents", inv.revision)
    own, digests = (_live(store, inv.revision, t, wanted["scan_ids"]) for t in ("entries", "hashes"))
    tests, lookup = [], inv
    if where := wanted["directory"]:
        path, lookup = _directory(store, inv, own.zones, where)
        tests += [F.col("scan_id") == where["scan_id"], *([_starting(path + "/")] if path else [])]
    tests += [_starting(wanted["path"][k]) for k in ("starts_with", "under") if wanted["path"][k]]
    falling, by_path = wanted["descending"], wanted["sort"] == "PATH"
    far, near = ("least_key", "most_key") if falling else ("most_key", "least_key")
    if by_path and position is not None:
        tests.append(F.col(far) <= position[0] if falling else F.col(far) >= position[0])
    zones = own.zones.filter(F.coalesce(P.every(tests), F.lit(True)))  # those without bounds are always allowed
    if grams := wanted_grams(wanted):
        held = P.scoped(store.stored("grams", inv.revision), wanted["scan_ids"]).filter(F.col("gram").isin(grams))
        all_ = held.groupBy("scan_id", "written", "file").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams))
        zones = zones.join(all_, ["scan_id", "written", "file"], "left_semi")
    ordered = zones.orderBy(F.col(near).desc_nulls_first() if falling else F.col(near).asc_nulls_first(), "scan_id", "file")
    size = FIRST if by_path else MOST_FILES
    while True:
        found = ordered.limit(size + 1).collect()
        if len(found) > MOST_FILES:
            return search.page(inv, request, position), None
        part, edge = found[:size], found[size][near] if len(found) > size else None
        few = inv.with_tables(entries=store.files("entries", [*own.loose, *map(_place, part)]), hashes=_digests(store, inv, own, digests, part))
        rows = search.first(few, wanted, position, lookup)
        if len(found) <= size or _complete(rows, wanted["limit"], edge, falling):
            return search.finished(inv, rows, wanted), len(part)
        size *= STEP


def _digests(store: Store, inv: Inventory, own: Chosen, digests: Chosen, part: list) -> DataFrame:
    """What can hold the digests of chosen files' entries; of entries without zones, every digest can be the one."""
    bounded = [z for z in part if z["least_key"] is not None]
    if own.loose or len(bounded) < len(part):
        return inv.hashes
    low, high = min((z["least_key"] for z in part), default=None), max((z["most_key"] for z in part), default=None)
    near = (F.col("most_key") >= low) & (F.col("least_key") <= high) if part else F.col("least_key").isNull()
    found = digests.zones.filter(F.coalesce(near, F.lit(True))).limit(MOST_FILES + 1).collect()
    return inv.hashes if len(found) > MOST_FILES else store.files("hashes", [*digests.loose, *map(_place, _overlapping(found, part))])


def _complete(rows: DataFrame, limit: int, edge: str | None, falling: bool) -> bool:
    """Whether no file past `edge` can hold a row of the page."""
    keys = [r[0] for r in rows.select("sort_key").collect()]  # a page's
    if edge is None or len(keys) <= limit or None in keys:
        return False
    return min(keys) > edge if falling else max(keys) < edge

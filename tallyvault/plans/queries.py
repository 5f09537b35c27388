"""Every operator as a query over the derived inventory, with the same query for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyvault import cursor, layout, storage
from tallyvault.functions import paths
from tallyvault.inventory import Inventory, Store
from tallyvault.operators import archives, audit, browse, candidates, contents, duplicates, images, merge, scenario, search, signatures
from tallyvault.operators import predicates as P
from tallyvault.plans.testbed import SQL, inventory
from tallyvault.schemas import BASE, SCHEMAS, conforming, differences
from tallyvault.sources import filesystem, hashing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, sql: str | None, make: Callable[[Inventory], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(inventory(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = SQL + sql


_SHOWN = "CASE WHEN relative_path = '' THEN root ELSE root || CASE WHEN ends_with(root, '/') THEN '' ELSE '/' END || relative_path END"
_OBS = ", obs AS (SELECT e.*, h.sha256, x.relative_path IS NOT NULL AS has_error FROM entries e LEFT JOIN hashes h USING (scan_id, entry_id) LEFT JOIN (SELECT DISTINCT scan_id, relative_path FROM scan_errors) x ON x.scan_id = e.scan_id AND x.relative_path = e.relative_path)"


# hashing


def _candidates(name: str, rehash: bool, complete: bool) -> None:
    sql = f"""SELECT scan_id, entry_id, relative_path, size, sha256 FROM entries e LEFT JOIN hashes USING (scan_id, entry_id)
    WHERE scan_id = 2 AND kind = 'FILE' AND (({rehash} AND sha256 IS NOT NULL) OR (sha256 IS NULL AND ({complete} OR size IN (SELECT size FROM entries WHERE scan_id = 2 AND kind = 'FILE' GROUP BY size HAVING count(*) > 1))))"""
    _add(name, sql, lambda inv: candidates.to_hash(inv, 2, rehash, complete).drop("modified_sec", "modified_nano"))


def _unhashed(inv: Inventory) -> Inventory:
    """Scan 2 with only its even entries hashed, so that every mode has something to do."""
    return inv.with_tables(hashes=inv.hashes.filter("scan_id <> 2 or entry_id % 2 = 0"))


_candidates("hash_candidates_default", False, False)
_candidates("hash_candidates_rehash", True, False)
_candidates("hash_candidates_complete", False, True)
_add(
    "hash_candidates_partly_hashed",
    """, h AS (SELECT * FROM hashes WHERE scan_id <> 2 OR entry_id % 2 = 0) SELECT scan_id, entry_id, relative_path, size FROM entries LEFT JOIN h USING (scan_id, entry_id)
    WHERE scan_id = 2 AND kind = 'FILE' AND sha256 IS NULL AND size IN (SELECT size FROM entries WHERE scan_id = 2 AND kind = 'FILE' GROUP BY size HAVING count(*) > 1)""",
    lambda inv: candidates.to_hash(_unhashed(inv), 2).select("scan_id", "entry_id", "relative_path", "size"),
)
_add(
    "hash_upsert",
    """SELECT scan_id, entry_id, coalesce(CASE WHEN entry_id % 3 = 0 THEN sha256(sha256) END, sha256) AS sha256 FROM hashes""",
    lambda inv: candidates.upserted(inv.hashes, inv.hashes.filter("entry_id % 3 = 0").withColumn("sha256", F.sha2(F.col("sha256").cast("binary"), 256))),
)
_add(
    "hash_insert_if_absent", "SELECT scan_id, entry_id, sha256 FROM hashes WHERE scan_id = 2 AND entry_id % 2 = 1",
    lambda inv: candidates.absent(inv.hashes.filter("scan_id = 2"), _unhashed(inv).hashes, inv.entries.filter("kind = 'FILE'").select("scan_id", "entry_id")).select("scan_id", "entry_id", "sha256"),
)
_add(
    "discovery_queue", "SELECT scan_id, entry_id, relative_path FROM dirs WHERE scan_id = 1 AND entry_id > 1 ORDER BY entry_id LIMIT 3",
    lambda inv: candidates.unfinished_directories(inv.with_tables(directories=inv.directories.withColumn("completed", F.col("entry_id") == 1)), 1, 3).drop("parent_id"),
)
_add(
    "discovery_recovery", "SELECT scan_id, entry_id FROM entries WHERE NOT (scan_id = 3 AND parent_id = 2)",
    lambda inv: candidates.without_partial_walk(inv.with_tables(scans=inv.scans.withColumn("active_dir", F.when(F.col("scan_id") == 3, F.lit(2).cast("long")))), 3).select("scan_id", "entry_id"),
)

# one scan

_add(
    "duplicate_report",
    f"SELECT size, sha256, n AS copies, entry_id, relative_path, {_SHOWN} AS path FROM entries JOIN hashes USING (scan_id, entry_id) JOIN scans USING (scan_id) JOIN (SELECT size, sha256, count(*) AS n FROM entries JOIN hashes USING (scan_id, entry_id) WHERE scan_id = 1 GROUP BY ALL HAVING count(*) > 1) USING (size, sha256) WHERE scan_id = 1",
    lambda inv: duplicates.report(inv, "scan-1").drop("partial"),
)
_STATUS = """SELECT 2::BIGINT AS scan_id, 'scan-2' AS name, 'COMPLETE' AS phase, count(*) FILTER (kind = 'FILE') AS files, count(*) FILTER (kind = 'DIRECTORY') AS directories, 0::BIGINT AS symlinks, 0::BIGINT AS others,
    sum(size) FILTER (kind = 'FILE')::HUGEINT::VARCHAR AS file_bytes, (SELECT count(*) FROM hashes WHERE scan_id = 2) AS hashes, 0::BIGINT AS pending_directories, (SELECT count(*) FROM scan_errors WHERE scan_id = 2) AS errors,
    (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM entries WHERE scan_id = 2 AND kind = 'FILE' GROUP BY size HAVING count(*) > 1)) AS candidate_files FROM entries WHERE scan_id = 2"""
_add("scan_status", _STATUS, lambda inv: duplicates.status(inv, "scan-2"))

# several scans

_NAMES = ["scan-3", "scan-1", "scan-2"]
_CROSS = """, pick AS (SELECT * FROM (VALUES (3::BIGINT, 0), (1, 1), (2, 2)) v(scan_id, scan_ordinal)), sizes AS (SELECT size, count(DISTINCT scan_id) AS scan_count, count(*) AS files FROM entries SEMI JOIN pick USING (scan_id) WHERE kind = 'FILE' GROUP BY size HAVING count(DISTINCT scan_id) >= 2),
cand AS (SELECT e.scan_id, e.entry_id, scan_ordinal, relative_path, size, sha256 FROM entries e JOIN pick USING (scan_id) SEMI JOIN sizes USING (size) LEFT JOIN hashes h ON h.scan_id = e.scan_id AND h.entry_id = e.entry_id WHERE kind = 'FILE'),
grp AS (SELECT size, sha256, count(*) AS copies, count(DISTINCT scan_id) AS scan_count FROM cand WHERE sha256 IS NOT NULL GROUP BY ALL HAVING count(DISTINCT scan_id) >= 2)
"""
_add("cross_candidate_sizes", _CROSS + "SELECT * FROM sizes", lambda inv: candidates.cross_sizes(inv, candidates.selected(inv, _NAMES)))
_add("cross_candidates", _CROSS + "SELECT scan_id, entry_id, scan_ordinal, size, sha256 FROM cand", lambda inv: candidates.cross_candidates(inv, candidates.selected(inv, _NAMES)).drop("relative_path"))
_add("cross_counters", _CROSS + "SELECT count(*) AS candidate_files, count(sha256) AS existing_hashes, count(*) FILTER (sha256 IS NULL) AS pending_files FROM cand", lambda inv: candidates.cross_counters(inv, candidates.selected(inv, _NAMES)))
_add("cross_groups", _CROSS + "SELECT * FROM grp", lambda inv: duplicates.cross_groups(inv, _NAMES))
_add("cross_report", _CROSS + f"SELECT size, sha256, copies, scan_count, scan_ordinal, name AS scan_name, entry_id, relative_path, {_SHOWN} AS path FROM cand JOIN grp USING (size, sha256) JOIN scans USING (scan_id)", lambda inv: duplicates.cross_report(inv, _NAMES))

# browsing

_add(
    "dashboard",
    """SELECT (SELECT count(*) FROM scans) AS scans, count(*) FILTER (kind = 'FILE') AS files, count(*) FILTER (kind = 'DIRECTORY') AS directories, sum(size) FILTER (kind = 'FILE')::HUGEINT::VARCHAR AS file_bytes,
    (SELECT count(*) FROM hashes) AS hashes, (SELECT count(*) FROM scan_errors) AS errors, (SELECT count(*) FROM (SELECT 1 FROM entries JOIN hashes USING (scan_id, entry_id) GROUP BY size, sha256 HAVING count(*) > 1)) AS duplicate_groups FROM entries""",
    browse.dashboard,
)
_add(
    "scan_summaries",
    """SELECT scan_id, name, phase, (SELECT count(*) FROM entries e WHERE e.scan_id = s.scan_id AND kind = 'FILE') AS files, (SELECT count(*) FROM entries e WHERE e.scan_id = s.scan_id AND kind = 'DIRECTORY') AS directories,
    (SELECT coalesce(sum(size), 0)::HUGEINT::VARCHAR FROM entries e WHERE e.scan_id = s.scan_id AND kind = 'FILE') AS file_bytes, (SELECT count(*) FROM hashes h WHERE h.scan_id = s.scan_id) AS hashes, (SELECT count(*) FROM scan_errors x WHERE x.scan_id = s.scan_id) AS errors FROM scans s""",
    browse.summaries,
)
_add("scan_list_filtered", "SELECT scan_id, name, root, phase FROM scans s WHERE contains(lower(name), 'scan') AND EXISTS (SELECT 1 FROM scan_errors x WHERE x.scan_id = s.scan_id) AND scan_id > 1 ORDER BY scan_id LIMIT 3", lambda inv: browse.scans(inv, name="SCAN", has_errors=True, after=1, limit=2))
_add("scan_list_without_errors", "SELECT scan_id, name, root, phase FROM scans s WHERE phase = 'COMPLETE' AND NOT EXISTS (SELECT 1 FROM scan_errors x WHERE x.scan_id = s.scan_id)", lambda inv: browse.scans(inv.with_tables(scan_errors=inv.scan_errors), phase="COMPLETE", has_errors=False))
_CHILD = """, kids AS (SELECT scan_id, entry_id, filename, kind, relative_path, size, CASE kind WHEN 'DIRECTORY' THEN 0 ELSE 1 END AS rank, sha256 FROM entries LEFT JOIN hashes USING (scan_id, entry_id) WHERE scan_id = 1 AND parent_id = {p} AND {w} ORDER BY rank, filename, entry_id LIMIT {n}),
    stats AS (SELECT size, sha256, count(*) AS n FROM entries JOIN hashes USING (scan_id, entry_id) WHERE kind = 'FILE' GROUP BY ALL) SELECT kids.*, coalesce(n, 0) AS copies FROM kids LEFT JOIN stats USING (size, sha256)"""
_add("children_page", _CHILD.format(p=3, w="true", n=21), lambda inv: browse.children(inv, 1, 3, 20))
_add("children_of_root", _CHILD.format(p=1, w="true", n=101), lambda inv: browse.children(inv, 1, 1))
_add("children_keyset", _CHILD.format(p=3, w="(filename > 'doc-12.img' OR (filename = 'doc-12.img' AND entry_id > 1012))", n=11), lambda inv: browse.children(inv, 1, 3, 10, [1, "doc-12.img", 1012]))
_add(
    "breadcrumbs", ", me AS (SELECT relative_path AS p FROM entries WHERE scan_id = 1 AND entry_id = 1010) SELECT scan_id, entry_id, parent_id, filename, relative_path, CASE WHEN relative_path = '' THEN 0 WHEN relative_path = p THEN 2 ELSE 1 END AS level FROM entries, me WHERE scan_id = 1 AND (relative_path = '' OR relative_path = p OR starts_with(p, relative_path || '/'))",
    lambda inv: browse.breadcrumbs(inv, 1, 1010),
)
_add(
    "entry_detail",
    f"SELECT scan_id, entry_id, parent_id, filename, kind, relative_path, {_SHOWN} AS path, size, sha256, (SELECT count(*) FROM entries e JOIN hashes h USING (scan_id, entry_id) WHERE e.size = x.size AND h.sha256 = x.sha256) AS copies, (SELECT count(DISTINCT scan_id) FROM entries e JOIN hashes h USING (scan_id, entry_id) WHERE e.size = x.size AND h.sha256 = x.sha256) AS scan_copies FROM (SELECT * FROM entries LEFT JOIN hashes USING (scan_id, entry_id) WHERE scan_id = 1 AND entry_id = 1003) x JOIN scans USING (scan_id)",
    lambda inv: browse.entry(inv, 1, 1003),
)
_add("errors_page", "SELECT * FROM scan_errors WHERE scan_id = 1 ORDER BY recorded_at_ms DESC, phase, relative_path, message LIMIT 4 OFFSET 2", lambda inv: browse.errors(inv, 1, 2, 3))
_add("errors_of_scan", "SELECT * FROM scan_errors WHERE scan_id = 2", lambda inv: browse.all_errors(inv, 2))
_add("scan_list", "SELECT scan_id, name, root, phase FROM scans", lambda inv: inv.scans.select("scan_id", "name", "root", "phase").orderBy("scan_id"))

# search

_KEYS = {"PATH": "lower(relative_path)", "NAME": "lower(filename)", "SCAN": "lower(name)", "SIZE": "size", "MODIFIED": "modified_sec::HUGEINT * 1000000000 + modified_nano"}


def _search(name: str, where: str, request: dict, sort: str = "PATH", descending: bool = False, limit: int = 100, scope: str = "true", position: list | None = None, past: str = "true") -> None:
    way = "DESC" if descending else "ASC"
    sql = f"""{_OBS}, seen AS (SELECT * FROM obs WHERE {scope}), stats AS (SELECT size, sha256, count(*) AS copies, count(DISTINCT scan_id) AS scan_copies FROM seen WHERE kind = 'FILE' AND sha256 IS NOT NULL GROUP BY ALL)
    SELECT scan_id, entry_id, name AS scan_name, relative_path, {_SHOWN} AS path, size, modified_sec, CASE WHEN sha256 IS NULL THEN 'UNHASHED' ELSE 'HASHED' END AS hash_state, coalesce(copies, 0) AS copies, coalesce(scan_copies, 0) AS scan_copies, has_error
    FROM seen LEFT JOIN stats USING (size, sha256) JOIN scans USING (scan_id) WHERE {where if "kind" in where else "kind = 'FILE' AND " + where} AND {past} ORDER BY {_KEYS[sort]} {way}, scan_id {way}, entry_id {way} LIMIT {limit + 1}"""
    full = request | {"sort": sort, "descending": descending, "limit": limit}
    _add(f"search_{name}", sql, lambda inv: search.page(inv, full, position).select("scan_id", "entry_id", "scan_name", "relative_path", "path", "size", "modified_sec", "hash_state", "copies", "scan_copies", "has_error"))


def _named(match: str, value: str, sensitive: bool = False) -> dict:
    return {"name": {"value": value, "match": match, "case_sensitive": sensitive}}


_ANY = "coalesce(copies, 0)"
_search("name_contains", "contains(lower(filename), 'doc-1')", _named("CONTAINS", "DOC-1"))
_search("name_starts", "starts_with(lower(filename), 'doc-2')", _named("STARTS_WITH", "Doc-2"))
_search("name_ends", "ends_with(lower(filename), '.log')", _named("ENDS_WITH", ".log"))
_search("name_exact", "lower(filename) = 'doc-6.log'", _named("EXACT", "doc-6.log"))
_search("name_exact_case", "filename = 'doc-6.log'", _named("EXACT", "doc-6.log", True))
_search("name_glob", r"regexp_matches(filename, '^doc\-.5\..*$', 'i')", _named("GLOB", "doc-?5.*"))
_search("name_regex", r"regexp_matches(filename, '^doc-[0-9]*7\.(txt|MD|log)$', 'i')", _named("REGEX", r"^doc-[0-9]*7\.(txt|MD|log)$"))
_search("name_regex_case", r"regexp_matches(filename, 'LOG$', 'c')", _named("REGEX", "LOG$", True))
_search("name_injection", "false", _named("EXACT", "x' OR 1=1 --"))
_search("path_contains", "contains(relative_path, 'n/doc-3')", {"path": {"contains": "n/doc-3"}})
_search("path_starts", "starts_with(relative_path, 'en/doc-4')", {"path": {"starts_with": "en/doc-4"}})
_search("path_under", "(relative_path = 'es' OR starts_with(relative_path, 'es/'))", {"path": {"under": "es/"}})
_search("path_excludes", "NOT starts_with(relative_path, 'en/') AND NOT starts_with(relative_path, 'fr/')", {"path": {"excludes": ["en", "fr"]}})
_search("ext", "(ends_with(lower(filename), '.log') OR ends_with(lower(filename), '.md'))", {"extensions": ["LOG", ".md"]})
_search("size_range", "size BETWEEN 500 AND 900", {"size": {"min": 500, "max": 900}}, sort="SIZE")
_search("size_exact", "size = 416", {"size": {"exact": 416}})
_search("modified_range", "modified_sec BETWEEN 1700020000 AND 1700030000", {"modified": {"min": 1_700_020_000, "max": 1_700_030_000}}, sort="MODIFIED")
_search("hash_state_hashed", "sha256 IS NOT NULL", {"hash_state": "HASHED"})
_search("hash_state_unhashed", "sha256 IS NULL", {"hash_state": "UNHASHED"})
_search("dup_copies2", f"{_ANY} >= 2", {"duplicate_state": "COPIES_2"})
_search("dup_copies3", f"{_ANY} >= 3", {"duplicate_state": "COPIES_3"})
_search("dup_across", "coalesce(scan_copies, 0) >= 2", {"duplicate_state": "ACROSS_SCANS", "scan_ids": [1, 2, 3]}, scope="scan_id IN (1, 2, 3)")
_search("dup_not_confirmed", f"{_ANY} < 2", {"duplicate_state": "NOT_CONFIRMED", "scan_ids": [2]}, scope="scan_id = 2")
_search("error_has", "has_error", {"error_state": "HAS"})
_search("error_none", "NOT has_error", {"error_state": "NONE"})
_search("dir_recursive", "scan_id = 1 AND starts_with(relative_path, '') AND entry_id <> 1", {"directory": {"scan_id": 1, "entry_id": 1, "recursive": True}})
_search("dir_immediate", "scan_id = 1 AND parent_id = 4", {"directory": {"scan_id": 1, "entry_id": 4, "recursive": False}})
_search("kinds", "kind IN ('DIRECTORY', 'SYMLINK')", {"kinds": ["DIRECTORY", "SYMLINK"]})
_search("scope", "true", {"scan_ids": [3, 2, 3]}, scope="scan_id IN (2, 3)")
for _s in _KEYS:
    _search(f"sort_{_s.lower()}", "true", {}, sort=_s, descending=_s != "PATH")
_search("keyset_page2", "true", {}, sort="SIZE", limit=50, position=["1500", 2, 1100], past="(size > 1500 OR (size = 1500 AND (scan_id > 2 OR (scan_id = 2 AND entry_id > 1100))))")
_search("combined", "contains(lower(filename), 'doc') AND size >= 1000 AND NOT has_error AND sha256 IS NOT NULL AND ends_with(lower(filename), '.txt')", _named("CONTAINS", "doc") | {"size": {"min": 1000}, "error_state": "NONE", "hash_state": "HASHED", "extensions": ["txt"]})

# groups of copies


def _groups(where: str, scope: str, having: str) -> str:
    return f"""{_OBS}, grp AS (SELECT size, sha256, size::VARCHAR || ':' || sha256 AS group_id, count(*) AS occurrences, count(DISTINCT scan_id) AS scan_count, count(*) FILTER ({where}) AS matching_occurrences, count(*) FILTER (has_error) AS error_occurrences,
    min(relative_path) AS sample_path, size::HUGEINT * count(*) AS observed_bytes FROM obs WHERE kind = 'FILE' AND sha256 IS NOT NULL AND {scope} GROUP BY size, sha256 HAVING count(*) FILTER ({where}) > 0 AND {having})
    """


def _group_query(name: str, request: dict, where: str = "true", scope: str = "scan_id IN (1, 2, 3, 4)", having: str = "count(*) >= 2", order: str = "size DESC, size DESC, sha256 DESC", limit: int = 100) -> None:
    full = {"scan_ids": [1, 2, 3, 4], "limit": limit} | request
    sql = _groups(where, scope, having) + f"SELECT * REPLACE (observed_bytes::VARCHAR AS observed_bytes) FROM (SELECT * FROM grp ORDER BY {order} LIMIT {limit + 1})"
    _add(f"dup_groups_{name}", sql, lambda inv: duplicates.group_page(inv, full))


_ACROSS = "count(*) >= 2 AND count(DISTINCT scan_id) >= 2"
_group_query("any", {})
_group_query("across", {"min_scans": 2}, having=_ACROSS)
_group_query("filtered", _named("ENDS_WITH", ".txt") | {"path": {"under": "en"}}, where="ends_with(lower(filename), '.txt') AND starts_with(relative_path, 'en/')")
_group_query("with_errors", {"error_state": "HAS"}, where="has_error")
_group_query("three", {"min_occurrences": 3}, having="count(*) >= 3")
_group_query("sort_size", {"sort": "SIZE", "descending": False}, order="size, sha256", limit=30)
_group_query("sort_occ", {"sort": "OCCURRENCES"}, order="occurrences DESC, size DESC, sha256 DESC", limit=30)
_group_query("sort_scans", {"sort": "SCANS"}, order="scan_count DESC, size DESC, sha256 DESC", limit=30)
_group_query("sort_bytes", {"sort": "OBSERVED_BYTES"}, order="observed_bytes DESC, size DESC, sha256 DESC", limit=30)
_add("dup_group_summary", _groups("true", "scan_id IN (1, 2, 3, 4)", "count(*) >= 2") + "SELECT count(*) AS groups, coalesce(sum(occurrences), 0)::HUGEINT::VARCHAR AS occurrences, coalesce(sum(observed_bytes), 0)::HUGEINT::VARCHAR AS observed_bytes FROM grp", lambda inv: duplicates.group_summary(inv, {"scan_ids": [1, 2, 3, 4]}))
_add("dup_coverage", f"{_OBS} SELECT count(*) AS files, count(sha256) AS hashed_files, count(*) FILTER (sha256 IS NULL) AS unhashed_files, count(*) FILTER (has_error) AS files_with_errors, 0::BIGINT AS incomplete_scans, (SELECT count(*) FROM scan_errors WHERE scan_id IN (1, 2)) AS errors FROM obs WHERE kind = 'FILE' AND scan_id IN (1, 2)", lambda inv: duplicates.coverage(inv, [2, 1]))


def _anchor(inv: Inventory) -> dict:
    """A hashed file: the one with the least id that has copies within scans 1 to 4."""
    files = duplicates.hashed_files(inv).filter("scan_id <= 4")
    row = files.join(P.copies(files).filter("copies > 1"), ["size", "sha256"]).orderBy("scan_id", "entry_id").select("scan_id", "entry_id", "size", "sha256").first()
    return row.asDict()


_ANCHOR = ", f AS (SELECT scan_id, entry_id, size, sha256, count(*) OVER (PARTITION BY size, sha256) AS n FROM entries JOIN hashes USING (scan_id, entry_id) WHERE scan_id <= 4), anchor AS (SELECT size, sha256 FROM f WHERE n > 1 ORDER BY scan_id, entry_id LIMIT 1)"
_add("dup_anchor", _groups("true", "scan_id <= 4", "count(*) >= 2") + _ANCHOR + " SELECT grp.* REPLACE (observed_bytes::VARCHAR AS observed_bytes) FROM grp SEMI JOIN anchor USING (size, sha256)", lambda inv: duplicates.group_page(inv, {"scan_ids": [1, 2, 3, 4], "reference": {k: _anchor(inv)[k] for k in ("scan_id", "entry_id")}}))
_add(
    "dup_occurrences", f"{_OBS}{_ANCHOR} SELECT scan_id, name AS scan_name, entry_id, relative_path, {_SHOWN} AS path, has_error, ends_with(lower(filename), '.txt') AS matches_filters FROM obs SEMI JOIN anchor USING (size, sha256) JOIN scans USING (scan_id) WHERE kind = 'FILE' AND scan_id <= 4 ORDER BY scan_id, relative_path, entry_id LIMIT 101",
    lambda inv: duplicates.occurrences(inv, f"{_anchor(inv)['size']}:{_anchor(inv)['sha256']}", {"scan_ids": [1, 2, 3, 4], "extensions": ["txt"]}),
)

# retention plans

_KEY = "CASE WHEN regexp_matches(scan_root, '^[A-Za-z]:/') OR starts_with(scan_root, '//') THEN lower({0}) ELSE {0} END"
_PATH = "scan_root || CASE WHEN ends_with(scan_root, '/') THEN '' ELSE '/' END || relative_path"


def _plan(order: str = "", protected: str = "false", match: str = "true", manual: bool = False) -> str:
    d = f"CASE WHEN is_protected OR NOT target THEN 'KEEP' WHEN conflicting OR path_error OR NOT has_keeper THEN 'UNRESOLVED' {'ELSE ' + repr('UNDECIDED') if manual else 'WHEN path_key = keep_key THEN ' + repr('KEEP') + ' ELSE ' + repr('REMOVE')} END"
    r = f"CASE WHEN is_protected THEN 'PROTECTED' WHEN NOT target THEN 'OUTSIDE_SCOPE' WHEN conflicting THEN 'CONFLICTING_HISTORY' WHEN path_error THEN 'RECORDED_ERROR' WHEN NOT has_keeper THEN 'NO_CONFIRMED_KEEPER' {'ELSE ' + repr('MANUAL_REQUIRED') if manual else 'WHEN path_key = keep_key THEN ' + repr('RULE_KEEPER') + ' ELSE ' + repr('RULE_REDUNDANT')} END"
    return f"""{_OBS}, located AS (SELECT o.*, root AS scan_root FROM obs o JOIN scans USING (scan_id) WHERE kind = 'FILE'), keyed AS (SELECT *, {_KEY.format("(" + _PATH + ")")} AS path_key, {match} AS filter_match FROM located),
    past AS (SELECT path_key, bool_or(sha256 IS NULL) OR count(DISTINCT size::VARCHAR || ':' || coalesce(sha256, 'UNHASHED')) > 1 AS conflicting FROM keyed GROUP BY path_key),
    grp AS (SELECT size, sha256 FROM keyed WHERE sha256 IS NOT NULL GROUP BY ALL HAVING count(*) >= 2 AND count(*) FILTER (filter_match) > 0),
    marked AS (SELECT k.*, k.size::VARCHAR || ':' || k.sha256 AS group_id, conflicting, bool_and(filter_match) OVER p AS target, bool_or({protected}) OVER p AS is_protected, bool_or(has_error) OVER p AS path_error
        FROM keyed k SEMI JOIN grp USING (size, sha256) JOIN past USING (path_key) WINDOW p AS (PARTITION BY k.size, k.sha256, k.path_key)),
    chosen AS (SELECT *, first_value(path_key) OVER (PARTITION BY group_id ORDER BY CASE WHEN conflicting OR path_error THEN 1 ELSE 0 END, CASE WHEN is_protected OR NOT target THEN 0 ELSE 1 END, {order} path_key, scan_id, entry_id) AS keep_key,
        bool_or(NOT conflicting AND NOT path_error) OVER (PARTITION BY group_id) AS has_keeper FROM marked),
    made AS (SELECT *, {d} AS decision, {r} AS reason FROM chosen)
    """


_DEPTH = "length(relative_path) - length(replace(relative_path, '/', ''))"
_ALL = {"scan_ids": [1, 2, 3, 4, 5]}
_DECIDED = "SELECT group_id, scan_id, entry_id, path_key, target AS matches_filters, path_error AS has_error, is_protected AS protected, conflicting, decision, reason FROM made"


def _scenario(name: str, config: dict, **parts) -> None:
    full = {"request": _ALL} | config
    _add(f"scenario_decisions_{name}", _plan(**parts) + _DECIDED, lambda inv: scenario.decisions(inv, full).select("group_id", "scan_id", "entry_id", "path_key", "matches_filters", "has_error", "protected", "conflicting", "decision", "reason"))


_scenario("shallowest", {"rules": [{"kind": "SHALLOWEST"}]}, order=f"{_DEPTH},")
_scenario("newest", {"rules": [{"kind": "NEWEST"}]}, order="modified_sec DESC, modified_nano DESC,")
_scenario("oldest", {"rules": [{"kind": "OLDEST"}]}, order="modified_sec, modified_nano,")
_scenario("prefer_scan", {"rules": [{"kind": "PREFER_SCAN", "scan_id": 3}, {"kind": "NEWEST"}]}, order="CASE WHEN scan_id = 3 THEN 0 ELSE 1 END, modified_sec DESC, modified_nano DESC,")
_EN = _KEY.format("relative_path")
_scenario("prefer_path", {"rules": [{"kind": "PREFER_PATH", "path": "EN", "scan_id": 2}]}, order=f"CASE WHEN scan_id = 2 AND starts_with({_EN}, 'en/') THEN 0 ELSE 1 END,")
_scenario("manual", {"manual": True}, manual=True)
_scenario("protected", {"protections": [{"path": "en"}, {"path": "", "scan_id": 4}]}, protected=f"(starts_with({_EN}, 'en/') OR scan_id = 4)")
_scenario("filtered", {"request": _ALL | {"extensions": ["txt", "md"]}, "rules": [{"kind": "OLDEST"}]}, order="modified_sec, modified_nano,", match="(ends_with(lower(filename), '.txt') OR ends_with(lower(filename), '.md'))")
_add("scenario_conflicts", _plan() + "SELECT path_key, conflicting FROM past", lambda inv: scenario.history(inv, _ALL["scan_ids"]))
_OLDEST = {"request": _ALL, "rules": [{"kind": "OLDEST"}]}


def _overrides(inv: Inventory) -> DataFrame:
    """Every third group's paths are kept by hand, every fifth's are to go, and one override is stale."""
    base = scenario.decisions(inv, _OLDEST).select("path_key", "group_id", F.col("size").alias("s")).distinct()
    made = base.withColumn("decision", F.when(F.col("s") % 3 == 0, "KEEP").when(F.col("s") % 5 == 0, "REMOVE")).filter("decision is not null").drop("s")
    return made.unionByName(inv.spark.createDataFrame([("nowhere", "1:0", "KEEP")], "path_key string, group_id string, decision string"))


_MANUAL = "CASE WHEN size % 3 = 0 THEN 'KEEP' WHEN size % 5 = 0 THEN 'REMOVE' END"
_TAKEN = f"(size % 3 = 0 OR (size % 5 = 0 AND NOT is_protected AND NOT path_error AND NOT conflicting AND target))"
_OVER = _plan(order="modified_sec, modified_nano,") + f", over AS (SELECT * REPLACE (CASE WHEN {_TAKEN} THEN {_MANUAL} ELSE decision END AS decision, CASE WHEN {_TAKEN} THEN 'MANUAL' ELSE reason END AS reason) FROM made)\n"
_add("scenario_overrides", _OVER + "SELECT group_id, scan_id, entry_id, path_key, decision, reason FROM over", lambda inv: scenario.decisions(inv, _OLDEST, _overrides(inv)).select("group_id", "scan_id", "entry_id", "path_key", "decision", "reason"))


def _group_sql(source: str) -> str:
    def n(test: str) -> str:
        return f"count(DISTINCT path_key) FILTER ({test})"

    return f""", sg AS (SELECT group_id, size, sha256, min(relative_path) AS sample_path, count(*) AS occurrences, count(DISTINCT path_key) AS recorded_paths, {n("decision = 'KEEP'")} AS keep_count, {n("decision = 'KEEP' AND NOT path_error AND NOT conflicting")} AS keeper_count,
    {n("decision = 'REMOVE'")} AS remove_count, {n("decision = 'UNDECIDED'")} AS undecided_count, {n("decision = 'UNRESOLVED'")} AS unresolved_count, size::HUGEINT * {n("decision = 'REMOVE'")} AS candidate_bytes FROM {source} GROUP BY group_id, size, sha256)
    """


_MADE = _plan(order="modified_sec, modified_nano,") + _group_sql("made")
_add("scenario_groups", _MADE + "SELECT * REPLACE (candidate_bytes::VARCHAR AS candidate_bytes) FROM sg", lambda inv: scenario.groups(scenario.decisions(inv, _OLDEST)).withColumn("candidate_bytes", F.col("candidate_bytes").cast("string")))
_add(
    "scenario_summary",
    _MADE + """SELECT count(*) AS groups, sum(occurrences)::HUGEINT::VARCHAR AS observations, sum(size::HUGEINT * occurrences)::HUGEINT::VARCHAR AS observed_bytes, sum(candidate_bytes)::HUGEINT::VARCHAR AS candidate_bytes, (SELECT count(DISTINCT path_key) FROM made) AS recorded_paths,
    (SELECT count(DISTINCT path_key) FROM made WHERE decision = 'KEEP') AS keep, (SELECT count(DISTINCT path_key) FROM made WHERE decision = 'REMOVE') AS remove, (SELECT count(DISTINCT path_key) FROM made WHERE decision = 'UNDECIDED') AS undecided, (SELECT count(DISTINCT path_key) FROM made WHERE decision = 'UNRESOLVED') AS unresolved FROM sg""",
    lambda inv: scenario.summary(scenario.decisions(inv, _OLDEST)),
)
_add(
    "scenario_validation",
    _OVER + _group_sql("over") + """, facts AS (SELECT 'UNSAFE_REMOVAL' AS code, (SELECT count(*) FROM over WHERE decision = 'REMOVE' AND (is_protected OR path_error OR conflicting OR NOT target)) AS count UNION ALL SELECT 'NO_RETAINED_CANDIDATE', (SELECT count(*) FROM sg WHERE remove_count > 0 AND keeper_count = 0)
    UNION ALL SELECT 'UNDECIDED_DECISIONS', (SELECT count(DISTINCT path_key) FROM over WHERE decision = 'UNDECIDED') UNION ALL SELECT 'STALE_OVERRIDES', 1 UNION ALL SELECT 'UNRESOLVED_PATHS', (SELECT count(DISTINCT path_key) FROM over WHERE conflicting OR path_error)) SELECT * FROM facts WHERE count > 0""",
    lambda inv: scenario.problems(scenario.decisions(inv, _OLDEST, _overrides(inv)), _overrides(inv)),
)

# signatures

_add("signature_counts", "SELECT id, count(*) AS files, count(DISTINCT scan_id) AS scans FROM signatures JOIN entries USING (size) JOIN hashes USING (scan_id, entry_id, sha256) WHERE kind = 'FILE' GROUP BY id", signatures.counts)
_FIRST = "(SELECT min(id) FROM signatures JOIN entries USING (size) JOIN hashes USING (scan_id, entry_id, sha256))"
_add(
    "signature_matches", f"SELECT scan_id, name AS scan_name, entry_id, relative_path, {_SHOWN} AS path, size, sha256 FROM signatures JOIN entries USING (size) JOIN hashes USING (scan_id, entry_id, sha256) JOIN scans USING (scan_id) WHERE id = {_FIRST} AND kind = 'FILE' ORDER BY scan_id, entry_id LIMIT 101",
    lambda inv: signatures.matches(inv, signatures.counts(inv).agg(F.min("id")).first()[0]),
)
_add(
    "signature_decorate", f"{_OBS}, page AS (SELECT scan_id, entry_id, size, sha256 FROM obs WHERE kind = 'FILE' ORDER BY lower(relative_path), scan_id, entry_id LIMIT 101) SELECT page.*, id AS signature_id, tag AS signature_tag FROM page LEFT JOIN signatures USING (size, sha256)",
    lambda inv: signatures.decorated(search.page(inv, {}).select("scan_id", "entry_id", "size", "sha256"), inv.signatures),
)

# archives

_FLAVORS = """, named AS (SELECT scan_id, entry_id AS source_id, relative_path, size, filename, regexp_extract(relative_path, '^(.*/)?[^/]*$', 1) AS folder FROM entries WHERE scan_id = 1 AND kind = 'FILE'),
inputs AS (SELECT scan_id, source_id, relative_path, size, CASE WHEN regexp_matches(filename, '\\.part[0-9]+\\.rar$', 'i') THEN 'rar-parts' WHEN regexp_matches(filename, '\\.zip$', 'i') THEN 'zip-split' END AS flavor,
    CASE WHEN regexp_matches(filename, '\\.part[0-9]+\\.rar$', 'i') THEN regexp_extract(filename, '(?i)\\.part([0-9]+)\\.rar$', 1)::INTEGER ELSE 0 END AS slot, folder || regexp_extract(filename, '(?i)^(.*?)(\\.part[0-9]+\\.rar|\\.zip)$', 1) AS stem FROM named WHERE regexp_matches(filename, '\\.(part[0-9]+\\.rar|zip)$', 'i')),
sets AS (SELECT *, flavor || ':' || stem AS group_key FROM inputs)
"""
_add("archive_classify", _FLAVORS + "SELECT scan_id, group_key, flavor, slot, source_id, relative_path, size FROM sets", lambda inv: archives.inputs(inv, 1).drop("modified_sec", "modified_nano"))
_add("archive_jobs", _FLAVORS + "SELECT scan_id, group_key, min(source_id) AS first_entry, min(flavor) AS flavor, 'PENDING' AS status FROM sets GROUP BY scan_id, group_key", lambda inv: archives.jobs(archives.inputs(inv, 1)).select("scan_id", "group_key", "first_entry", "flavor", "status"))


def _volumes(inv: Inventory) -> DataFrame:
    """Documents as volumes of sets of a few flavors with gaps, repeats and lone parts."""
    flavors = F.array(*[F.lit(x) for x in ("rar-parts", "7z-split", "rar-old", "zip-split", "single")])
    group = F.expr("entry_id div 3")
    files = inv.entries.filter("scan_id = 2 and kind = 'FILE'")
    return files.select(
        "scan_id", group.cast("string").alias("group_key"), F.element_at(flavors, (group % 5 + 1).cast("int")).alias("flavor"), F.when(F.col("size") % 7 == 0, 0).otherwise(F.col("entry_id") % 3 + F.when(group % 2 == 0, 1).otherwise(0)).cast("int").alias("slot"),
        F.col("entry_id").alias("source_id"), "relative_path", "size", "modified_sec", "modified_nano",
    )


_VOLUMES = """, vol AS (SELECT scan_id, (entry_id // 3)::VARCHAR AS group_key, list_extract(['rar-parts', '7z-split', 'rar-old', 'zip-split', 'single'], ((entry_id // 3) % 5 + 1)::BIGINT) AS flavor,
    (CASE WHEN size % 7 = 0 THEN 0 ELSE entry_id % 3 + CASE WHEN (entry_id // 3) % 2 = 0 THEN 1 ELSE 0 END END)::INTEGER AS slot, entry_id AS source_id, size FROM entries WHERE scan_id = 2 AND kind = 'FILE'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY CASE WHEN flavor = 'zip-split' AND slot = 0 THEN 1000000 ELSE slot END, source_id) AS rn, count(*) OVER (PARTITION BY group_key) AS n, bool_or(slot = 0) OVER (PARTITION BY group_key) AS zero FROM vol)
"""
_add(
    "archive_arrange",
    _VOLUMES + """SELECT scan_id, group_key, flavor, count(*) AS volumes, CASE flavor WHEN 'single' THEN false WHEN 'zip-split' THEN NOT bool_or(zero) OR bool_or(slot <> 0 AND slot <> rn) ELSE bool_or(slot <> rn - CASE WHEN flavor = 'rar-old' THEN 1 ELSE 0 END) END AS missing,
    count(DISTINCT slot) < count(*) AS ambiguous, CASE WHEN count(*) = 1 AND bool_or(zero) THEN 'single' ELSE flavor END AS reader_flavor FROM ranked GROUP BY scan_id, group_key, flavor""",
    lambda inv: archives.arranged(_volumes(inv)),
)
_HEX = "printf('%0{1}x', {0})"
_TAG = "'000e" + archives.SET_TAG.encode().hex() + "'"
_add(
    "archive_set_fingerprint",
    _VOLUMES + f""", entire AS (SELECT r.*, sha256 FROM ranked r LEFT JOIN hashes h ON h.scan_id = r.scan_id AND h.entry_id = r.source_id) SELECT scan_id, group_key, flavor, count(*)::INTEGER AS volumes, CASE WHEN bool_or(sha256 IS NULL) THEN NULL WHEN count(*) = 1 AND min(slot) = 0 THEN 'file-sha256:' || min(sha256)
    ELSE 'set-v1-sha256:' || sha256(unhex({_TAG} || {_HEX.format("octet_length(encode(flavor))", 4)} || lower(hex(flavor)) || {_HEX.format("count(*)", 8)} || string_agg({_HEX.format("slot", 8)} || {_HEX.format("size", 16)} || sha256, '' ORDER BY rn))) END AS fingerprint FROM entire GROUP BY scan_id, group_key, flavor""",
    lambda inv: archives.fingerprints(_volumes(inv), inv.hashes),
)
_add("archive_reachable", "SELECT result_id FROM reachable", lambda inv: archives.reached(inv, 1))
_add(
    "archive_list",
    """SELECT 'ROOT' AS location_kind, group_key AS source, NULL::VARCHAR AS parent_result_id, j.result_id, j.status, j.duplicate, j.diagnostic, a.fingerprint, a.provider, a.reusable, a.retryable, a.height FROM archive_jobs j LEFT JOIN archive_results a ON a.result_id = j.result_id
    UNION ALL SELECT 'NESTED', group_key, parent_result_id, child_result_id, a.state, n.duplicate, NULL, a.fingerprint, a.provider, a.reusable, a.retryable, a.height FROM archive_nested n JOIN archive_results a ON a.result_id = child_result_id WHERE parent_result_id IN (SELECT result_id FROM reachable)""",
    lambda inv: archives.listed(inv, "scan-1"),
)
_add(
    "archive_status",
    """, mem AS (SELECT * FROM archive_members WHERE result_id IN (SELECT result_id FROM reachable) AND result_id IN (SELECT result_id FROM archive_results WHERE state IN ('COMPLETE', 'PARTIAL'))) SELECT 1::BIGINT AS scan_id, 'scan-1' AS name, 'COMPLETE_WITH_ERRORS' AS phase, count(*) AS root_archives, count(*) FILTER (status = 'COMPLETE') AS completed,
    count(*) FILTER (status = 'PARTIAL') AS with_errors, count(*) FILTER (status = 'SKIPPED') AS skipped, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (duplicate) AS duplicate_roots, count(*) FILTER (retryable) AS retryable_roots, (SELECT count(*) FROM mem) AS indexed_members,
    (SELECT count(*) FROM mem WHERE sha256 IS NOT NULL AND integrity = 'READ_OK') AS checksummed_members, (SELECT count(*) FROM mem WHERE integrity = 'DAMAGED') AS damaged_members, (SELECT coalesce(sum(actual_size), 0)::HUGEINT::VARCHAR FROM mem) AS recovered_bytes,
    (SELECT count(*) FROM archive_nested WHERE parent_result_id IN (SELECT result_id FROM reachable)) AS nested_archives, (SELECT count(*) FROM archive_errors WHERE result_id IN (SELECT result_id FROM reachable)) + count(diagnostic) AS errors FROM archive_jobs""",
    lambda inv: archives.status(inv, "scan-1"),
)
_add("archive_errors", "SELECT * FROM archive_errors WHERE result_id IN (SELECT result_id FROM reachable) UNION ALL SELECT result_id, NULL, 'OPERATIONAL', 'JOB_ERROR', diagnostic FROM archive_jobs WHERE diagnostic IS NOT NULL", lambda inv: archives.errors(inv, "scan-1"))
_ONE = "00000001-0000-0000-0000-000000000007"
_add("archive_entries", f"SELECT result_id, ordinal, relative_path, actual_size, sha256, integrity FROM archive_members WHERE result_id = '{_ONE}'", lambda inv: archives.members(inv, _ONE).select("result_id", "ordinal", "relative_path", "actual_size", "sha256", "integrity"))
_add(
    "archive_cache_pick", "SELECT fingerprint, policy, first(result_id ORDER BY completed, result_id) AS result_id FROM archive_results WHERE reusable AND state IN ('COMPLETE', 'PARTIAL') AND height <= 62 GROUP BY ALL",
    lambda inv: archives.cached(inv.archive_results.select("fingerprint", "policy").distinct(), inv.archive_results, 62),
)

# images

_add(
    "image_identify", """SELECT scan_id, entry_id AS source_id, relative_path, CASE WHEN ends_with(filename, '.qcow2') THEN 'qcow2' ELSE 'raw' END AS format, size, 'PENDING' AS state FROM entries e WHERE scan_id = 2 AND kind = 'FILE' AND regexp_matches(lower(filename), '\\.(qcow2|img)$') AND NOT EXISTS (SELECT 1 FROM image_jobs j WHERE j.scan_id = e.scan_id AND j.source_id = e.entry_id)""",
    lambda inv: images.identified(inv, 2).drop("modified_sec", "modified_nano"),
)
_add("image_hash_gate", "SELECT scan_id, source_id, format, size, count(*) OVER (PARTITION BY format, size) > 1 AS hash FROM image_jobs", lambda inv: images.to_hash(inv.image_jobs).select("scan_id", "source_id", "format", "size", "hash"))
_add(
    "image_status",
    """, own AS (SELECT * FROM image_jobs WHERE scan_id = 1), g AS (SELECT * FROM image_entries WHERE result_id IN (SELECT result_id FROM own JOIN image_results USING (result_id))) SELECT 1::BIGINT AS scan_id, 'scan-1' AS name, 'COMPLETE' AS phase, count(*) AS candidates, count(*) FILTER (state = 'COMPLETE') AS complete, count(*) FILTER (state = 'PARTIAL') AS partial, count(*) FILTER (state = 'PENDING') AS pending,
    count(*) FILTER (state = 'COMPONENT') AS component_files, count(*) FILTER (duplicate) AS duplicates, count(*) FILTER (state = 'PARTIAL' OR diagnostic IS NOT NULL) AS errors, (SELECT count(*) FROM g) AS entries, (SELECT count(sha256) FROM g) AS hashes_completed, (SELECT coalesce(sum(actual_size) FILTER (sha256 IS NOT NULL), 0)::HUGEINT::VARCHAR FROM g) AS file_bytes FROM own""",
    lambda inv: images.status(inv, "scan-1"),
)
_add("image_list", "SELECT scan_id, source_id, relative_path, format, j.state, result_id, duplicate, diagnostic, fingerprint, virtual_size, provider FROM image_jobs j LEFT JOIN image_results r USING (result_id) WHERE scan_id = 2", lambda inv: images.listed(inv, "scan-2").select("scan_id", "source_id", "relative_path", "format", "state", "result_id", "duplicate", "diagnostic", "fingerprint", "virtual_size", "provider"))
_add("image_errors", "SELECT relative_path, result_id, filesystem_id, entry_id, category, code, message FROM image_jobs JOIN image_results USING (result_id) JOIN image_errors USING (result_id) WHERE scan_id = 1 UNION ALL SELECT relative_path, NULL, NULL, NULL, 'OPERATIONAL', 'JOB_FAILED', diagnostic FROM image_jobs WHERE scan_id = 1 AND diagnostic IS NOT NULL", lambda inv: images.errors(inv, "scan-1"))
_add("image_components_tree", "SELECT c.result_id, c.ordinal, c.parent_ordinal, c.role, p.role AS parent_role FROM image_components c LEFT JOIN image_components p ON p.result_id = c.result_id AND p.ordinal = c.parent_ordinal", images.component_tree)
_add("image_entries_of_result", "SELECT result_id, filesystem_id, entry_id, size, actual_size, sha256 FROM image_entries WHERE result_id = '00000002-0000-0000-0000-000000000001'", lambda inv: images.detail(inv, "image_entries", "00000002-0000-0000-0000-000000000001").select("result_id", "filesystem_id", "entry_id", "size", "actual_size", "sha256"))
_add(
    "image_cache_pick", "SELECT fingerprint, provider, policy, first(result_id ORDER BY completed, result_id) AS result_id FROM image_results WHERE reusable AND state = 'COMPLETE' GROUP BY ALL",
    lambda inv: images.cached(inv.image_results.select("fingerprint", "provider", "policy").distinct(), inv.image_results),
)

# audits of an inventory with planted faults


def _broken(inv: Inventory) -> Inventory:
    e = inv.entries.withColumn("parent_id", F.when(F.col("entry_id") % 50 == 3, 77).otherwise(F.col("parent_id"))).withColumn("size", F.when(F.col("entry_id") % 70 == 1, -1).otherwise(F.col("size")))
    h = inv.hashes.withColumn("sha256", F.when(F.col("entry_id") % 60 == 2, F.upper("sha256")).otherwise(F.col("sha256")))
    return inv.with_tables(entries=e.unionByName(e.filter("scan_id = 1 and entry_id = 1001")), hashes=h.unionByName(inv.spark.createDataFrame([(1, 3, "0" * 64)], SCHEMAS["hashes"])))


_FAULTS = """, e2 AS (SELECT * REPLACE (CASE WHEN entry_id % 50 = 3 THEN 77 ELSE parent_id END AS parent_id, CASE WHEN entry_id % 70 = 1 THEN -1 ELSE size END AS size) FROM entries), e3 AS (SELECT * FROM e2 UNION ALL SELECT * FROM e2 WHERE scan_id = 1 AND entry_id = 1001),
h3 AS (SELECT * REPLACE (CASE WHEN entry_id % 60 = 2 THEN upper(sha256) ELSE sha256 END AS sha256) FROM hashes UNION ALL SELECT 1, 3, repeat('0', 64))
"""
_add(
    "audit_entries", _FAULTS + "SELECT * FROM (SELECT 'entry repeated' AS rule, count(*) AS failures FROM (SELECT 1 FROM e3 GROUP BY scan_id, entry_id HAVING count(*) > 1) UNION ALL SELECT 'path repeated', count(*) FROM (SELECT 1 FROM e3 GROUP BY scan_id, relative_path HAVING count(*) > 1) UNION ALL SELECT 'entry shape', count(*) FROM e3 WHERE size < 0 OR (entry_id = 1 AND parent_id <> 0) OR (entry_id > 1 AND (parent_id < 1 OR parent_id >= entry_id))) WHERE failures > 0",
    lambda inv: audit.counted(audit.entries(_broken(inv))).filter("failures > 0"),
)
_add(
    "audit_tree", _FAULTS + "SELECT * FROM (SELECT 'parent or path' AS rule, count(*) AS failures FROM e3 e LEFT JOIN e3 p ON p.scan_id = e.scan_id AND p.entry_id = e.parent_id WHERE e.entry_id > 1 AND p.entry_id IS NULL UNION ALL SELECT 'queue is not the directories', count(*) FROM e3 e WHERE e.kind = 'DIRECTORY' AND e.parent_id = 77) WHERE failures > 0",
    lambda inv: audit.counted(audit.tree(_broken(inv))).filter("failures > 0"),
)
_add(
    "audit_hashes", _FAULTS + "SELECT * FROM (SELECT 'digest shape' AS rule, count(*) AS failures FROM h3 WHERE NOT regexp_full_match(sha256, '[0-9a-f]{64}') UNION ALL SELECT 'digest of no file', 1) WHERE failures > 0",
    lambda inv: audit.counted(audit.hashes(_broken(inv))).filter("failures > 0"),
)
_add(
    "audit_archive",
    "SELECT 'nested source' AS rule, (SELECT count(*) FROM archive_nested) AS failures UNION ALL SELECT 'archive jobs are not the sets', count(*) FROM archive_jobs UNION ALL SELECT 'nesting does not descend', (SELECT count(*) FROM archive_nested n JOIN archive_results a ON a.result_id = n.parent_result_id JOIN archive_results b ON b.result_id = n.child_result_id WHERE a.height <= b.height)",
    lambda inv: audit.counted({k: v for k, v in audit.archive(inv).items() if k in ("nested source", "archive jobs are not the sets", "nesting does not descend")}),
)
_add(
    "audit_image",
    "SELECT 'component tree' AS rule, 0::BIGINT AS failures UNION ALL SELECT 'guest entry repeated', count(*) FROM (SELECT 1 FROM image_entries GROUP BY result_id, filesystem_id, entry_id HAVING count(*) > 1) UNION ALL SELECT 'image job result', (SELECT count(*) FROM image_jobs WHERE result_id IS NULL AND (state = 'COMPLETE' OR duplicate))",
    lambda inv: audit.counted({k: v for k, v in audit.image(inv).items() if k in ("component tree", "guest entry repeated", "image job result")}),
)

# audit_archive and audit_image above keep three rules each, as their SQL does; these two count every rule, as the first three audits do
_add(
    "audit_archive_rules",
    """SELECT * FROM (SELECT 'nested source' AS rule, (SELECT count(*) FROM archive_nested) AS failures UNION ALL SELECT 'archive jobs are not the sets', count(*) FROM archive_jobs UNION ALL SELECT 'nesting does not descend', (SELECT count(*) FROM archive_nested n JOIN archive_results a ON a.result_id = n.parent_result_id JOIN archive_results b ON b.result_id = n.child_result_id WHERE a.height <= b.height)
    UNION ALL SELECT 'archive member repeated', count(*) FROM (SELECT 1 FROM archive_members GROUP BY result_id, ordinal HAVING count(*) > 1) UNION ALL SELECT 'nested set repeated', count(*) FROM (SELECT 1 FROM archive_nested GROUP BY parent_result_id, group_key HAVING count(*) > 1)
    UNION ALL SELECT 'archive job result', count(*) FROM archive_jobs j LEFT JOIN archive_results r USING (result_id) WHERE (result_id IS NOT NULL AND (state IS NULL OR status <> state)) OR (result_id IS NULL AND (status IN ('COMPLETE', 'SKIPPED') OR j.duplicate))) WHERE failures > 0""",
    lambda inv: audit.counted(audit.archive(inv)).filter("failures > 0"),
)
_add(
    "audit_image_rules",
    """SELECT * FROM (SELECT 'image job without run' AS rule, count(*) AS failures FROM image_jobs WHERE scan_id NOT IN (1, 2, 3) UNION ALL SELECT 'image job differs', count(*) FROM image_jobs j LEFT JOIN entries e ON e.scan_id = j.scan_id AND e.entry_id = j.source_id WHERE e.kind IS DISTINCT FROM 'FILE' OR e.relative_path <> j.relative_path OR e.size <> j.size
    UNION ALL SELECT 'image result of no file', count(*) FROM disks WHERE m NOT IN (5, 6) AND NOT EXISTS (SELECT 1 FROM entries e WHERE e.kind = 'FILE' AND e.scan_id = k % 4 + 1 AND e.entry_id = k) UNION ALL SELECT 'component differs', count(*) FROM image_components
    UNION ALL SELECT 'component tree', count(*) FROM image_components c LEFT JOIN image_components p ON p.result_id = c.result_id AND p.ordinal = c.parent_ordinal WHERE c.parent_ordinal < -1 OR (c.parent_ordinal = -1 AND (c.ordinal <> 0 OR c.role <> 'PRIMARY')) OR (c.parent_ordinal >= 0 AND (p.ordinal IS NULL OR p.ordinal >= c.ordinal))
    UNION ALL SELECT 'guest entry repeated', count(*) FROM (SELECT 1 FROM image_entries GROUP BY result_id, filesystem_id, entry_id HAVING count(*) > 1) UNION ALL SELECT 'guest path repeated', count(*) FROM (SELECT 1 FROM image_entries GROUP BY result_id, filesystem_id, entry_id // 8, entry_id % 8 HAVING count(*) > 1)
    UNION ALL SELECT 'image component job', count(*) FROM disks j LEFT JOIN disks p ON p.k = j.k - 4 AND p.k % 4 = j.k % 4 WHERE j.m = 6 AND (p.k IS NULL OR p.m = 6) UNION ALL SELECT 'image job result', (SELECT count(*) FROM image_jobs WHERE result_id IS NULL AND (state = 'COMPLETE' OR duplicate))) WHERE failures > 0""",
    lambda inv: audit.counted(audit.image(inv)).filter("failures > 0"),
)

# merging


def _sides(inv: Inventory) -> tuple[Inventory, Inventory]:
    """Scans 3 to 5 as the source, 1 and 2 as the destination."""
    cut = lambda test: inv.with_tables(**{t: getattr(inv, t).filter(test) for t in ("scans", "entries", "hashes", "scan_errors", "directories")})
    return cut("scan_id >= 3"), cut("scan_id < 3")


_MAP = ", map AS (SELECT * FROM (VALUES (3::BIGINT, 4::BIGINT), (4, 5), (5, 6)) v(old_scan_id, new_scan_id))"
_add("merge_scan_map", _MAP + " SELECT old_scan_id, new_scan_id, 'scan-' || old_scan_id::VARCHAR AS name FROM map", lambda inv: merge.scan_map(*_sides(inv)))
_add("merge_projection", _MAP + " SELECT new_scan_id AS scan_id, entry_id, parent_id, relative_path, size FROM entries JOIN map ON old_scan_id = scan_id", lambda inv: merge.projected(_sides(inv)[0].entries, merge.scan_map(*_sides(inv)), None).select("scan_id", "entry_id", "parent_id", "relative_path", "size"))
_add("merge_name_conflicts", "SELECT name FROM scans WHERE scan_id IN (2, 3)", lambda inv: merge.conflicts(inv.with_tables(scans=inv.scans.filter("scan_id <= 3")), inv.with_tables(scans=inv.scans.filter("scan_id in (2, 3, 5)"))))
_add(
    "merge_multiset_diff", """, a AS (SELECT scan_id, parent_id, size FROM entries WHERE kind = 'FILE' AND scan_id <> 4), b AS (SELECT scan_id, parent_id, CASE WHEN entry_id % 40 = 7 THEN size + 1 ELSE size END AS size FROM entries WHERE kind = 'FILE' AND scan_id <> 5)
    SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
    lambda inv: merge.differences(inv.entries.filter("kind = 'FILE' and scan_id <> 4").select("scan_id", "parent_id", "size"), inv.entries.filter("kind = 'FILE' and scan_id <> 5").select("scan_id", "parent_id", F.when(F.col("entry_id") % 40 == 7, F.col("size") + 1).otherwise(F.col("size")).alias("size"))),
)

# paths

_add("path_style", "SELECT scan_id, CASE WHEN regexp_matches(root, '^[A-Za-z]:/') THEN 'WINDOWS_DRIVE' WHEN starts_with(root, '//') THEN 'WINDOWS_UNC' ELSE 'POSIX' END AS style FROM scans", lambda inv: inv.scans.select("scan_id", paths.style(F.col("root")).alias("style")))


def _rooted(inv: Inventory) -> DataFrame:
    return inv.entries.join(F.broadcast(inv.scans.select("scan_id", F.col("root").alias("scan_root"))), "scan_id")


_ROOTED = ", rooted AS (SELECT e.*, root AS scan_root FROM entries e JOIN scans USING (scan_id))"
_add("path_join", f"SELECT scan_id, entry_id, {_SHOWN} AS path FROM entries JOIN scans USING (scan_id)", lambda inv: _rooted(inv).select("scan_id", "entry_id", paths.joined(F.col("scan_root"), F.col("relative_path")).alias("path")))
_add("path_key", f"{_ROOTED} SELECT scan_id, entry_id, {_KEY.format('(' + _PATH + ')')} AS path_key FROM rooted", lambda inv: _rooted(inv).select("scan_id", "entry_id", paths.key(F.col("scan_root"), paths.recorded(F.col("scan_root"), F.col("relative_path"))).alias("path_key")))
_add("path_depth", f"SELECT ({_DEPTH})::BIGINT AS depth, count(*) AS entries FROM entries GROUP BY depth", lambda inv: inv.entries.groupBy(paths.depth(F.col("relative_path")).cast("long").alias("depth")).agg(F.count("*").alias("entries")))
_add("candidate_sequence", "SELECT scan_id, entry_id, row_number() OVER (PARTITION BY scan_id ORDER BY entry_id) AS sequence FROM entries WHERE kind = 'FILE'", lambda inv: inv.entries.filter("kind = 'FILE'").select("scan_id", "entry_id", F.row_number().over(Window.partitionBy("scan_id").orderBy("entry_id")).cast("long").alias("sequence")))


# places in an order, and names of archives' members

_add("cross_sequence", _CROSS + "SELECT scan_id, entry_id, row_number() OVER (ORDER BY scan_ordinal, entry_id) AS sequence FROM cand", lambda inv: storage.numbered(candidates.cross_candidates(inv, candidates.selected(inv, _NAMES)), ["scan_ordinal", "entry_id"]).select("scan_id", "entry_id", "sequence"))
_add("archive_sequence", _FLAVORS + "SELECT source_id, row_number() OVER (ORDER BY source_id) AS sequence FROM sets", lambda inv: storage.numbered(archives.inputs(inv, 1), ["source_id"]).select("source_id", "sequence"))
_add(
    "candidate_page", "SELECT entry_id, row_number() OVER (ORDER BY entry_id) AS sequence FROM entries WHERE scan_id = 2 AND kind = 'FILE' ORDER BY entry_id LIMIT 9 OFFSET 12",
    lambda inv: candidates.sequence_page(inv.entries.filter("scan_id = 2 and kind = 'FILE'"), ["entry_id"], 12, 9).select("entry_id", "sequence"),
)
_MEMBERS = ["{}", "./{}//x", "/{}", "a/../{}", "C:/{}", "a\\{}", "a/./{}/", "..{}", "é:{}"]
_add(
    "member_paths",
    f""", n AS (SELECT scan_id, entry_id, replace(list_extract([{', '.join(repr(m) if chr(92) not in m else "'a' || chr(92) || '{}'" for m in _MEMBERS)}], (entry_id % 9 + 1)::BIGINT), '{{}}', relative_path) AS name FROM entries WHERE kind = 'FILE')
    SELECT scan_id, entry_id, CASE WHEN starts_with(name, '/') OR contains(name, chr(92)) OR regexp_matches(name, '^\\p{{L}}:') OR list_contains(string_split(name, '/'), '..') THEN NULL ELSE array_to_string(list_filter(string_split(name, '/'), lambda p: p NOT IN ('', '.')), '/') END AS path FROM n""",
    lambda inv: inv.entries.filter("kind = 'FILE'").withColumn("name", F.replace(F.element_at(F.array(*map(F.lit, _MEMBERS)), (F.col("entry_id") % 9 + 1).cast("int")), F.lit("{}"), F.col("relative_path"))).select("scan_id", "entry_id", paths.safe_member(F.col("name")).alias("path")),
)

# summaries, pages and cursors that other queries do not reach

_add(
    "cross_summary",
    _CROSS + """, late AS (SELECT phase, count(*) AS n FROM scan_errors SEMI JOIN pick USING (scan_id) GROUP BY phase), c AS (SELECT count(*) AS candidate_files, count(sha256) AS existing_hashes, count(*) FILTER (sha256 IS NULL) AS pending_files FROM cand)
    SELECT c.*, (SELECT count(*) FROM sizes) AS candidate_sizes, coalesce((SELECT n FROM late WHERE phase = 'DISCOVERY'), 0) AS discovery_errors, coalesce((SELECT n FROM late WHERE phase = 'HASHING'), 0) AS hash_errors,
    pending_files > 0 OR EXISTS (SELECT 1 FROM late) AS partial, CASE WHEN pending_files > 0 OR EXISTS (SELECT 1 FROM late) THEN 'COMPLETE_WITH_ERRORS' ELSE 'COMPLETE' END AS phase FROM c""",
    lambda inv: _told(inv, duplicates.cross_summary(inv, _NAMES), "candidate_files long, existing_hashes long, pending_files long, candidate_sizes long, discovery_errors long, hash_errors long, partial boolean, phase string"),
)


def _told(inv: Inventory, found: dict, schema: str) -> DataFrame:
    return inv.spark.createDataFrame([tuple(found[c.split()[0]] for c in schema.split(", "))], schema)


_WORST = "(SELECT min(relative_path) FROM scan_errors WHERE scan_id = 1)"
_add(
    "related_errors", f"SELECT * FROM scan_errors WHERE scan_id = 1 AND relative_path = {_WORST} ORDER BY recorded_at_ms DESC LIMIT 20",
    lambda inv: browse.related_errors(inv, 1, inv.scan_errors.filter("scan_id = 1").agg(F.min("relative_path")).first()[0]),
)
_add(
    "search_second_page", f"""{_OBS} SELECT scan_id, entry_id, relative_path FROM obs WHERE kind = 'FILE' AND ends_with(lower(filename), '.txt') ORDER BY lower(relative_path), scan_id, entry_id LIMIT 7 OFFSET 7""",
    lambda inv: inv.spark.createDataFrame([(r["scan_id"], r["entry_id"], r["relative_path"]) for r in _second(inv, {"extensions": ["txt"], "limit": 7})], "scan_id long, entry_id long, relative_path string"),
)


def _second(inv: Inventory, request: dict) -> list[dict]:
    """The page that the first one's cursor leads to."""
    return search.search(inv, request | {"cursor": search.search(inv, request)["next_cursor"]})["items"]


_search("name_exact_cased", "filename = 'doc-6.LOG'", _named("EXACT", "doc-6.LOG", True))
_search("kinds_all", "kind IN ('FILE', 'DIRECTORY') AND contains(relative_path, 'e')", {"kinds": ["FILE", "DIRECTORY"], "path": {"contains": "e"}})
_add(
    "scan_list_error_free", "SELECT scan_id, name, root, phase FROM scans s WHERE phase = 'COMPLETE' AND NOT EXISTS (SELECT 1 FROM scan_errors x WHERE x.scan_id = s.scan_id AND scan_id IN (1, 2))",
    lambda inv: browse.scans(inv.with_tables(scan_errors=inv.scan_errors.filter("scan_id in (1, 2)")), phase="COMPLETE", has_errors=False),
)
_add(
    "scenario_group_page", _MADE + "SELECT * REPLACE (candidate_bytes::VARCHAR AS candidate_bytes) FROM sg ORDER BY size DESC, sha256 LIMIT 8",
    lambda inv: cursor.page(scenario.groups(scenario.decisions(inv, _OLDEST)), [(F.col("size"), True), (F.col("sha256"), False)], 7).withColumn("candidate_bytes", F.col("candidate_bytes").cast("string")),
)
_add(
    "scenario_decision_page", _plan(order="modified_sec, modified_nano,") + "SELECT path_key, scan_id, entry_id, decision, reason FROM made WHERE group_id = (SELECT max(group_id) FROM made) ORDER BY path_key, scan_id, entry_id LIMIT 4",
    lambda inv: _decision_page(scenario.decisions(inv, _OLDEST)).select("path_key", "scan_id", "entry_id", "decision", "reason"),
)


def _decision_page(made: DataFrame) -> DataFrame:
    last = made.agg(F.max("group_id")).first()[0]
    return cursor.page(made.filter(F.col("group_id") == last), [(F.col(c), False) for c in ("path_key", "scan_id", "entry_id")], 3)


_add(
    "signature_list", """, n AS (SELECT id, count(*) AS files, count(DISTINCT scan_id) AS scans FROM signatures JOIN entries USING (size) JOIN hashes USING (scan_id, entry_id, sha256) WHERE kind = 'FILE' GROUP BY id)
    SELECT id, size, sha256, tag, coalesce(files, 0) AS files, coalesce(scans, 0) AS scans FROM signatures LEFT JOIN n USING (id) ORDER BY lower(tag), tag, id LIMIT 11""",
    lambda inv: signatures.listed(inv, 10).select("id", "size", "sha256", "tag", "files", "scans"),
)
_add(
    "signature_update", """SELECT id, CASE WHEN id = (SELECT min(id) FROM signatures) THEN 'other' ELSE tag END AS tag, CASE WHEN id = (SELECT min(id) FROM signatures) THEN 'a memo' ELSE '' END AS memo FROM signatures""",
    lambda inv: signatures.updated(inv, inv.signatures.agg(F.min("id")).first()[0], "other", "a memo").select("id", "tag", "memo"),
)


def _searches(inv: Inventory) -> Inventory:
    """A saved search for each scan, of two scanners."""
    rows = inv.scans.select(
        F.concat(F.lit("s-"), F.col("scan_id").cast("string")).alias("id"), F.when(F.col("scan_id") % 2 == 1, "odd").otherwise("even").alias("scanner_path"), F.col("name"), F.col("root").alias("description"), F.lit("{}").alias("request_json"), "created_at", "updated_at",
    )
    return inv.with_tables(saved_searches=rows)


_add("saved_search_list", "SELECT 's-' || scan_id::VARCHAR AS id, name, root AS description FROM scans WHERE scan_id % 2 = 1 ORDER BY lower(name), name, id LIMIT 501", lambda inv: signatures.saved_searches(_searches(inv), "odd").select("id", "name", "description"))
_add(
    "saved_search_update", "SELECT 's-' || scan_id::VARCHAR AS id, CASE WHEN scan_id = 3 THEN 'mine' ELSE name END AS name, CASE WHEN scan_id = 3 THEN 'new' ELSE root END AS description FROM scans",
    lambda inv: signatures.updated_search(_searches(inv), "s-3", "mine", description="new").select("id", "name", "description"),
)

# what an archive run derives from what it read


def _attempts(inv: Inventory) -> tuple[DataFrame, DataFrame, DataFrame]:
    ended = inv.archive_results.select("result_id", (F.col("height") % 5 != 4).alias("ended"), (F.col("fingerprint") != "print-7").alias("whole"))
    below = inv.archive_results.select(F.col("result_id").alias("child_result_id"), F.col("reusable").alias("child_reusable"), F.col("height").alias("child_height"))
    children = inv.archive_nested.join(below, "child_result_id").select(F.col("parent_result_id").alias("result_id"), "child_reusable", "child_height")
    return inv.archive_errors, ended, children


_add(
    "archive_outcome",
    """, e AS (SELECT result_id, count(*) AS n, count(*) FILTER (category = 'OPERATIONAL') AS op, count(*) FILTER (category IN ('LIMIT', 'CAPABILITY')) AS lim FROM archive_errors GROUP BY result_id),
    c AS (SELECT parent_result_id AS result_id, bool_and(reusable) AS sound, max(height) + 1 AS above FROM archive_nested JOIN archive_results r ON r.result_id = child_result_id GROUP BY parent_result_id)
    SELECT r.result_id, CASE WHEN n IS NULL THEN 'COMPLETE' ELSE 'PARTIAL' END AS state, coalesce(op, 0) > 0 AS retryable, height % 5 <> 4 AND fingerprint <> 'print-7' AND coalesce(op, 0) = 0 AND coalesce(lim, 0) = 0 AND coalesce(sound, true) AS reusable,
    coalesce(above, 0)::INTEGER AS height FROM archive_results r LEFT JOIN e ON e.result_id = r.result_id LEFT JOIN c ON c.result_id = r.result_id""",
    lambda inv: archives.outcome(*_attempts(inv)),
)
def _told_by_readers(inv: Inventory) -> DataFrame:
    """Every result as three readers would tell it, one of which found its volumes changed."""
    none, own = F.lit(None), lambda c: F.concat("reader", F.lit("/"), F.col(c))
    readers = F.explode(F.array(*[F.lit(r) for r in ("one", "two", "lost")])).alias("reader")
    rows = inv.archive_members.groupBy("result_id").agg(F.count("*").alias("told"))
    results = inv.archive_results.join(rows, "result_id", "left").select("*", readers).select("reader", F.lit("result").alias("what"), own("result_id").alias("result_id"), none.cast("long").alias("ordinal"), none.cast("string").alias("child_result_id"), F.col("result_id").alias("final_id"), F.coalesce("told", F.lit(0)).alias("told"))
    members = inv.archive_members.select("*", readers).select("reader", F.lit("member").alias("what"), own("result_id").alias("result_id"), "ordinal")
    nested = inv.archive_nested.select("*", readers).select("reader", F.lit("nested").alias("what"), own("parent_result_id").alias("result_id"), none.cast("long").alias("ordinal"), own("child_result_id").alias("child_result_id"))
    changed = inv.spark.createDataFrame([("lost", "changed")], "reader string, what string")
    return results.unionByName(members, True).unionByName(nested, True).unionByName(changed, True)


_add(
    "archive_resolved",
    """ SELECT 'result' AS what, result_id, NULL::BIGINT AS ordinal, NULL AS child_result_id FROM archive_results
    UNION ALL SELECT 'member', result_id, ordinal, NULL FROM archive_members UNION ALL SELECT 'nested', parent_result_id, NULL, child_result_id FROM archive_nested""",
    lambda inv: archives.resolved(_told_by_readers(inv)).select("what", "result_id", "ordinal", "child_result_id"),
)
_add(
    "archive_nested_sets",
    f""", m AS (SELECT 'g-' || (7 * ordinal % 3)::VARCHAR AS group_key, CASE WHEN ordinal % 2 = 0 THEN 'single' ELSE 'rar-parts' END AS flavor, ordinal FROM archive_members WHERE result_id = '{_ONE}'),
    s AS (SELECT group_key, min(flavor) AS flavor, min(ordinal) AS source_ordinal FROM m GROUP BY group_key) SELECT row_number() OVER (ORDER BY source_ordinal, group_key) AS sequence, group_key, flavor, source_ordinal FROM s""",
    lambda inv: archives.nested_sets(inv.with_tables(archive_members=inv.archive_members.withColumn("group_key", F.concat(F.lit("g-"), (7 * F.col("ordinal") % 3).cast("string"))).withColumn("flavor", F.when(F.col("ordinal") % 2 == 0, "single").otherwise("rar-parts"))), _ONE),
)
_add(
    "archive_volumes_of_result",
    _VOLUMES + f"SELECT '{_ONE}' AS result_id, rn AS ordinal, slot, source_id, size FROM ranked WHERE group_key = (SELECT min(group_key) FROM vol WHERE flavor = 'zip-split')",
    lambda inv: archives.volumes(_with_volumes(inv), _ONE).select("result_id", "ordinal", "slot", "source_id", "size"),
)


def _with_volumes(inv: Inventory) -> Inventory:
    """The volumes of one set as those of one result."""
    found = _volumes(inv)
    first = found.filter("flavor = 'zip-split'").agg(F.min("group_key")).first()[0]
    place = F.row_number().over(Window.partitionBy("group_key").orderBy(archives.volume_order(F.col("flavor"), F.col("slot")), "source_id"))
    own = found.filter(F.col("group_key") == first).select(F.lit(_ONE).alias("result_id"), place.alias("ordinal"), "slot", "source_id", F.col("relative_path").alias("source_path"), "size", F.lit(None).cast("string").alias("sha256"))
    return inv.with_tables(archive_volumes=own)


_DISK = "00000002-0000-0000-0000-000000000001"
_add("image_filesystems_of_result", f"SELECT '{_DISK}' AS result_id, nation + 1 AS filesystem_id, '/dev/sda1' AS device, 'ext4' AS type FROM disks WHERE k = 1", lambda inv: images.detail(inv, "image_filesystems", _DISK).select("result_id", "filesystem_id", "device", "type"))
_add(
    "image_partitions_of_result", f"SELECT '{_DISK}' AS result_id, '/dev/sda1' AS device, l_linenumber::BIGINT AS number, l_orderkey * 512 AS start_bytes FROM lineitem WHERE l_suppkey = 1",
    lambda inv: images.detail(inv.with_tables(image_partitions=inv.image_entries.select("result_id", F.lit("/dev/sda1").alias("device"), (F.col("entry_id") % 8).alias("number"), (F.expr("entry_id div 8") * 512).alias("start_bytes"), F.lit(512).cast("long").alias("size_bytes"), F.lit("gpt").alias("table_type"))), "image_partitions", _DISK).select("result_id", "device", "number", "start_bytes"),
)


_BYTES = "printf('%016x', CASE WHEN {0} < 0 THEN 18446744073709551615::HUGEINT ELSE {0} END)"
_UTF = "printf('%04x', strlen({0})) || lower(hex({0}))"
_FORMAT = f"list_extract([{', '.join(repr(f) for f in ('qcow2', 'vmdk', 'raw', 'vpc', 'vdi'))}], (k % 5 + 1)::BIGINT)"
_add(
    "image_fingerprints",
    f""", c AS (SELECT '00000002-0000-0000-0000-' || lpad(k::VARCHAR, 12, '0') AS result_id, o::BIGINT AS ordinal, (o - 1)::HUGEINT AS parent, list_extract(['PRIMARY', 'BACKING', 'EXTENT'], (o + 1)::BIGINT) AS role, {_FORMAT} AS format, (k % 7 * 1000)::BIGINT AS size
        FROM disks, range(0, 3) r(o) WHERE m NOT IN (5, 6) AND (o = 0 OR (o = 1 AND k % 3 = 0) OR (o = 2 AND k % 6 = 0)))
    SELECT result_id, sha256(unhex({_UTF.format("'" + images.SHAPE_TAG + "'")} || printf('%08x', count(*)) || string_agg(printf('%016x', ordinal) || CASE WHEN parent < 0 THEN 'ffffffffffffffff' ELSE printf('%016x', parent::BIGINT) END || {_UTF.format("role")} || {_UTF.format("format")} || printf('%016x', size), '' ORDER BY ordinal))) AS fingerprint FROM c GROUP BY result_id""",
    lambda inv: images.fingerprints(inv.image_components, "result_id", contents=False),
)

# merging whole rows, its counts and ids; stored shapes

_add(
    "merge_row_counts", "SELECT 'scans' AS name, count(*) AS n FROM scans WHERE scan_id >= 3 UNION ALL SELECT 'entries', count(*) FROM entries WHERE scan_id >= 3 UNION ALL SELECT 'hashes', count(*) FROM hashes WHERE scan_id >= 3 UNION ALL SELECT 'scan_errors', count(*) FROM scan_errors WHERE scan_id >= 3 UNION ALL SELECT 'directories', count(*) FROM dirs WHERE scan_id >= 3",
    lambda inv: merge.row_counts(_sides(inv)[0], ["scans", "entries", "directories", "hashes", "scan_errors"]),
)
_add("merge_id_range", _MAP + " SELECT min(new_scan_id) AS first_id, max(new_scan_id) AS last_id FROM map", lambda inv: merge.scan_map(*_sides(inv)).agg(F.min("new_scan_id").alias("first_id"), F.max("new_scan_id").alias("last_id")))
_add(
    "merge_multiset_rows", """, a AS (SELECT * FROM entries WHERE scan_id <> 4), b AS (SELECT * REPLACE (CASE WHEN entry_id % 40 = 7 THEN modified_nano + 1 ELSE modified_nano END AS modified_nano) FROM entries WHERE scan_id <> 5)
    SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
    lambda inv: merge.differences(inv.entries.filter("scan_id <> 4"), inv.entries.filter("scan_id <> 5").withColumn("modified_nano", F.when(F.col("entry_id") % 40 == 7, F.col("modified_nano") + 1).otherwise(F.col("modified_nano")))),
)
_add(
    "merge_imported", _MAP + " SELECT new_scan_id AS scan_id, entry_id, sha256 FROM hashes JOIN map ON old_scan_id = scan_id",
    lambda inv: _imported(*_sides(inv)),
)


def _imported(source: Inventory, destination: Inventory) -> DataFrame:
    scans = merge.scan_map(source, destination)
    return merge.imported(destination.hashes.unionByName(merge.projected(source.hashes, scans, None)), scans, None)


_add(
    "schema_differences", "SELECT * FROM (VALUES ('entries.size: missing'), ('entries.kind: bigint, not string'), ('entries.more: unknown')) v(difference)",
    lambda inv: inv.spark.createDataFrame([(x,) for x in differences(inv.entries.drop("size").withColumn("kind", F.lit(1).cast("long")).withColumn("more", F.lit(1)), "entries")], "difference string"),
)


def _conforming(inv: Inventory, tables: list[str]) -> DataFrame:
    """Tables that have the stored schema, in any order of columns, with their rows."""
    shuffled = [(t, getattr(inv, t).select(*reversed(SCHEMAS[t].names))) for t in tables]
    counted = [conforming(df, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), F.lit(len(SCHEMAS[t])).alias("columns"), "n") for t, df in shuffled]
    return reduce(DataFrame.unionByName, counted)


_add(
    "schema_of_tables", "SELECT 'scans' AS name, 9 AS columns, count(*) AS n FROM scans UNION ALL SELECT 'entries', 9, count(*) FROM entries UNION ALL SELECT 'hashes', 3, count(*) FROM hashes UNION ALL SELECT 'scan_errors', 5, count(*) FROM scan_errors",
    lambda inv: _conforming(inv, ["scans", "entries", "hashes", "scan_errors"]),
)

# a store's own tables; these write files, so they are tested against the same requests without a store

CLUSTERED = {"name": {"value": "doc-1", "match": "STARTS_WITH"}, "path": {"under": "en"}, "limit": 200}


def _clustered(inv: Inventory) -> DataFrame:
    """A search over a store of all scans, sorted by path, with counts of contents kept."""
    store = Store(inv.spark, storage.new_folder(inv.spark, "store"))
    store.save(**{t: getattr(inv, t) for t in BASE})
    layout.clustered(store, [r[0] for r in inv.scans.select("scan_id").collect()])
    contents.refreshed(store)
    return layout.page(store, CLUSTERED)


_add("search_clustered", None, _clustered)

# sources, over the tables' own files; what SQL cannot read has no twin


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filesystem.discover(spark, sf_dir, 1)[0]


def _file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = spark.createDataFrame([(1, sf_dir.removeprefix("file://").rstrip("/"))], "scan_id long, root string")
    return hashing.hashed(_tree(spark, sf_dir).filter("kind = 'FILE'"), scans)[0]


QUERIES["discover_tree"] = _tree
QUERIES["hash_files"] = _file_hashes


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

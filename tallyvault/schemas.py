"""Schemas of the inventory tables, by version, and the check that a table has one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DecimalType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

VERSION = 1

# fixed values: the stored columns of each table
_DDL = {
    "scans": "scan_id long, name string, root string, phase string, algorithm string, active_dir long, next_entry_id long, created_at timestamp, updated_at timestamp",
    "entries": "scan_id long, entry_id long, parent_id long, relative_path string, filename string, kind string, size long, modified_sec long, modified_nano int",
    "directories": "scan_id long, entry_id long, parent_id long, relative_path string, completed boolean",
    "hashes": "scan_id long, entry_id long, sha256 string",
    "scan_errors": "scan_id long, phase string, relative_path string, message string, recorded_at_ms long",
    "archive_runs": "scan_id long, phase string",
    "archive_inputs": "scan_id long, group_key string, flavor string, slot int, source_id long, relative_path string, size long, modified_sec long, modified_nano int",
    "archive_jobs": "scan_id long, group_key string, first_entry long, flavor string, status string, result_id string, duplicate boolean, retryable boolean, diagnostic string",
    "archive_results": "result_id string, scan_id long, source_label string, fingerprint string, policy string, provider string, state string, retryable boolean, reusable boolean, height int, summary_json string, started_at timestamp, completed_at timestamp",
    "archive_volumes": "result_id string, ordinal int, slot int, source_id long, source_path string, size long, sha256 string",
    "archive_members": "result_id string, ordinal long, relative_path string, filename string, kind string, declared_size long, actual_size long, modified_sec long, modified_nano int, sha256 string, recovered_sha256 string, integrity string, encrypted boolean, raw_path_base64 string, diagnostic string, group_key string, flavor string, volume_slot int",
    "archive_nested": "parent_result_id string, group_key string, source_ordinal long, child_result_id string, duplicate boolean",
    "archive_errors": "result_id string, ordinal long, category string, code string, message string",
    "image_runs": "scan_id long, phase string",
    "image_jobs": "scan_id long, source_id long, relative_path string, format string, size long, modified_sec long, modified_nano long, state string, result_id string, duplicate boolean, retryable boolean, component_of long, diagnostic string",
    "image_results": "result_id string, scan_id long, source_id long, state string, fingerprint string, signature string, provider string, policy string, virtual_size long, reusable boolean, retryable boolean, summary_json string, started_at timestamp, completed_at timestamp",
    "image_components": "result_id string, ordinal long, parent_ordinal long, role string, format string, source_id long, relative_path string, size long, modified_sec long, modified_nano long, sha256 string",
    "image_partitions": "result_id string, device string, number long, start_bytes long, size_bytes long, table_type string",
    "image_filesystems": "result_id string, filesystem_id long, device string, type string, uuid string, label string, size_bytes long, state string",
    "image_entries": "result_id string, filesystem_id long, entry_id long, relative_path string, filename string, kind string, size long, actual_size long, modified_sec long, modified_nano long, sha256 string, integrity string",
    "image_errors": "result_id string, filesystem_id long, entry_id long, category string, code string, message string",
    "signatures": "id string, algorithm string, size long, sha256 string, tag string, memo string, created_at timestamp, updated_at timestamp",
    "scenarios": "id string, name string, config_json string, status string, revision long, generation_id string, snapshot_json string, created_at timestamp, updated_at timestamp",
    "scenario_decisions": "scenario_id string, generation_id string, group_id string, scan_id long, entry_id long, parent_id long, scan_name string, scan_root string, relative_path string, filename string, path string, path_key string, size long, modified_sec long, modified_nano int, sha256 string, matches_filters boolean, has_error boolean, protected boolean, conflicting boolean, auto_decision string, auto_reason string, decision string, reason string",
    "scenario_groups": "scenario_id string, generation_id string, group_id string, size long, sha256 string, sample_path string, occurrences long, recorded_paths long, keep_count long, keeper_count long, remove_count long, undecided_count long, unresolved_count long, candidate_bytes decimal",
    "scenario_overrides": "scenario_id string, path_key string, group_id string, decision string, updated_at timestamp",
    "saved_searches": "id string, scanner_path string, name string, description string, request_json string, created_at timestamp, updated_at timestamp",
}
_TYPES = {"long": LongType(), "int": IntegerType(), "string": StringType(), "boolean": BooleanType(), "timestamp": TimestampType(), "decimal": DecimalType(38, 0)}


def _schema(ddl: str) -> StructType:
    """Without a session, which Spark's own parser would need."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


SCHEMAS: dict[str, StructType] = {name: _schema(ddl) for name, ddl in _DDL.items()}
#: With what only a store has: of scans that are being discovered, the directories that are
#: not listed yet; files by content; and of tables that are sorted by path, the bounds of each
#: file (of paths and of what pages are sorted by) and the hashed trigrams of its names.
#: `written` is the generation of that file; folders give a column `generation`, which would hide one of that name.
STORED = SCHEMAS | {
    "frontier": SCHEMAS["directories"],
    "contents": _schema("scan_id long, size long, sha256 string, files long"),
    "zones": _schema("scan_id long, of string, written string, file string, rows long, least string, most string, least_key string, most_key string"),
    "grams": _schema("scan_id long, written string, file string, gram int"),
}
BASE = ("scans", "entries", "directories", "hashes", "scan_errors")
ARCHIVE = tuple(t for t in _DDL if t.startswith("archive_"))
IMAGE = tuple(t for t in _DDL if t.startswith("image_"))


class UnsupportedSchema(ValueError):
    code = "UNSUPPORTED_SCHEMA"


def differences(df: DataFrame, table: str) -> list[str]:
    """What keeps `df` from being `table`: columns that are missing, of another type, or unknown."""
    want = {f.name: f.dataType.simpleString() for f in STORED[table].fields}
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = [f"{table}.{c}: missing" for c in want if c not in have]
    out += [f"{table}.{c}: {have[c]}, not {t}" for c, t in want.items() if c in have and have[c] != t]
    return out + [f"{table}.{c}: unknown" for c in have if c not in want]


def conforming(df: DataFrame, table: str) -> DataFrame:
    """`df` with the table's columns in order; another version's or another table's columns are refused, never guessed."""
    if found := differences(df, table):
        raise UnsupportedSchema("; ".join(found))
    return df.select(*STORED[table].names)

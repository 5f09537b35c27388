"""Requests in a normal form: defaults filled in, lists sorted, bounds checked."""

from __future__ import annotations

import re

from tallyvault.errors import InvalidFilter

# fixed values: the bounds of a request
PAGE, MOST_PAGE = 100, 500
MOST_SCANS, MOST_EXTENSIONS, MOST_EXTENSION, MOST_EXCLUDES = 1000, 100, 64, 50
MOST_NAME, MOST_PATH = 1000, 4096
KINDS = ("DIRECTORY", "FILE", "SYMLINK", "OTHER")
NAME_MATCHES = ("CONTAINS", "STARTS_WITH", "ENDS_WITH", "EXACT", "REGEX", "GLOB")
HASH_STATES = ("ANY", "HASHED", "UNHASHED")
DUPLICATE_STATES = ("ANY", "CONFIRMED", "COPIES_2", "COPIES_3", "ACROSS_SCANS", "NOT_CONFIRMED")
ERROR_STATES = ("ANY", "HAS", "NONE")
FILE_SORTS = ("PATH", "NAME", "SCAN", "SIZE", "MODIFIED")
GROUP_SORTS = ("SIZE", "OCCURRENCES", "SCANS", "OBSERVED_BYTES")
MOST_TOTAL = 10**38 - 1


def one_of(value: str | None, allowed: tuple[str, ...], default: str) -> str:
    value = default if value is None else value
    if value not in allowed:
        raise InvalidFilter(f"{value!r} is not one of {', '.join(allowed)}")
    return value


def page_size(limit: int | None) -> int:
    limit = PAGE if limit is None else limit
    if not 1 <= limit <= MOST_PAGE:
        raise InvalidFilter(f"a page has 1 to {MOST_PAGE} rows")
    return limit


def scan_ids(ids: list[int] | None, needed: bool = False) -> list[int]:
    found = sorted(set(ids or []))
    if (needed and not found) or len(found) > MOST_SCANS:
        raise InvalidFilter(f"1 to {MOST_SCANS} scans are needed" if needed else f"at most {MOST_SCANS} scans")
    return found


def whole(value: int | None, least: int | None = 0) -> int | None:
    if value is not None and (isinstance(value, bool) or not isinstance(value, int) or (least is not None and value < least)):
        raise InvalidFilter(f"{value!r} is not a whole number in range")
    return value


def between(exact: int | None, low: int | None, high: int | None, least: int | None = 0) -> dict:
    if exact is not None and (low is not None or high is not None):
        raise InvalidFilter("an exact value excludes a range")
    if low is not None and high is not None and low > high:
        raise InvalidFilter("the range is empty")
    return {"exact": whole(exact, least), "min": whole(low, least), "max": whole(high, least)}


def path(value: str | None) -> str | None:
    if value is not None and len(value) > MOST_PATH:
        raise InvalidFilter(f"a path has at most {MOST_PATH} characters")
    return value or None


def extensions(values: list[str] | None) -> list[str]:
    out = sorted({v.lower().removeprefix(".") for v in values or []})
    if len(out) > MOST_EXTENSIONS or any(not v or len(v) > MOST_EXTENSION or re.search(r"[/\\]", v) for v in out):
        raise InvalidFilter("an extension cannot be used")
    return out


def file_filter(request: dict) -> dict:
    """The content predicates of a file request in normal form."""
    name, paths, size, time, where = (request.get(k) or {} for k in ("name", "path", "size", "modified", "directory"))
    value = name.get("value")
    if value is not None and not 1 <= len(value) <= MOST_NAME:
        raise InvalidFilter(f"a name has 1 to {MOST_NAME} characters")
    kinds = request.get("kinds", ["FILE"])
    if not kinds or any(k not in KINDS for k in kinds):
        raise InvalidFilter("unknown kind, or none")
    excludes = sorted({p.rstrip("/") for p in paths.get("excludes") or [] if path(p)})
    if len(excludes) > MOST_EXCLUDES:
        raise InvalidFilter(f"at most {MOST_EXCLUDES} paths can be excluded")
    return {
        "kinds": sorted(set(kinds)),
        "directory": {"scan_id": where["scan_id"], "entry_id": where["entry_id"], "recursive": bool(where.get("recursive", True))} if where else None,
        "name": {"value": value, "match": one_of(name.get("match"), NAME_MATCHES, "CONTAINS"), "case_sensitive": bool(name.get("case_sensitive", False))} if value is not None else None,
        "path": {"contains": path(paths.get("contains")), "starts_with": path(paths.get("starts_with")), "under": path((paths.get("under") or "").rstrip("/")), "excludes": excludes},
        "extensions": extensions(request.get("extensions")),
        "size": between(size.get("exact"), size.get("min"), size.get("max")),
        "modified": between(time.get("exact"), time.get("min"), time.get("max"), least=None),
        "hash_state": one_of(request.get("hash_state"), HASH_STATES, "ANY"),
        "error_state": one_of(request.get("error_state"), ERROR_STATES, "ANY"),
    }


def file_search(request: dict) -> dict:
    return file_filter(request) | {
        "scan_ids": scan_ids(request.get("scan_ids")),
        "duplicate_state": one_of(request.get("duplicate_state"), DUPLICATE_STATES, "ANY"),
        "sort": one_of(request.get("sort"), FILE_SORTS, "PATH"),
        "descending": bool(request.get("descending", False)),
        "limit": page_size(request.get("limit")),
    }


def group_search(request: dict) -> dict:
    if set(request.get("kinds", ["FILE"])) != {"FILE"}:
        raise InvalidFilter("only files have copies")
    return file_filter(request) | {
        "scan_ids": scan_ids(request.get("scan_ids"), needed=True),
        "min_occurrences": max(2, whole(request.get("min_occurrences")) or 2),
        "min_scans": max(1, whole(request.get("min_scans")) or 1),
        "reference": request.get("reference"),
        "sort": one_of(request.get("sort"), GROUP_SORTS, "SIZE"),
        "descending": bool(request.get("descending", True)),
        "limit": page_size(request.get("limit")),
    }


def as_groups(request: dict) -> dict:
    """A file search as a request for groups of copies; searches that groups cannot answer are refused."""
    wanted = file_search(request)
    if wanted["hash_state"] == "UNHASHED" or wanted["duplicate_state"] == "NOT_CONFIRMED" or wanted["kinds"] != ["FILE"]:
        raise InvalidFilter("unhashed and unconfirmed files, and what is not a file, have no groups")
    least = {"COPIES_3": {"min_occurrences": 3}, "ACROSS_SCANS": {"min_scans": 2}}.get(wanted["duplicate_state"], {})
    kept = {k: request[k] for k in ("scan_ids", "name", "path", "extensions", "size", "modified", "directory", "error_state") if k in request}
    return group_search(kept | least)


_UNITS = {"B": 1} | {u: b**i for b, us in ((1000, "KB MB GB TB PB EB"), (1024, "KiB MiB GiB TiB PiB EiB")) for i, u in enumerate(us.split(), 1)}


def parsed_size(text: str) -> int:
    """Bytes of a size such as `1.5 GiB`: at most nine decimals, halves up, below 2**63."""
    m = re.fullmatch(r"\s*(\d+)(?:\.(\d{1,9}))?\s*([A-Za-z]+)?\s*", text)
    unit = next((v for k, v in _UNITS.items() if m and k.lower() == (m[3] or "B").lower()), None)
    if unit is None:
        raise InvalidFilter(f"{text!r} is no size")
    decimals = m[2] or ""
    bytes_ = (int(m[1] + decimals) * unit * 2 + 10 ** len(decimals)) // (2 * 10 ** len(decimals))
    if bytes_ >= 1 << 63:
        raise InvalidFilter(f"{text!r} is too large")
    return bytes_


def shown_size(size: int, binary: bool = True) -> str:
    base, names = (1024, "B KiB MiB GiB TiB PiB EiB") if binary else (1000, "B KB MB GB TB PB EB")
    power = 0
    while power < 6 and size >= base ** (power + 1):
        power += 1
    scaled = (size * 20 + base**power) // (2 * base**power)
    return f"{size} B" if not power else f"{scaled // 10}.{scaled % 10} {names.split()[power]}"

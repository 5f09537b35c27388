"""Keyset pages: opaque cursors that are bound to the request they came from."""

from __future__ import annotations

import base64
import hashlib
import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvault.errors import InvalidFilter


def fingerprint(request: dict) -> str:
    """Of a normalised request, without its page size and cursor."""
    bare = {k: v for k, v in request.items() if k not in ("limit", "cursor")}
    return hashlib.sha256(json.dumps(bare, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def encode(request: dict, position: list) -> str:
    body = json.dumps({"fingerprint": fingerprint(request), "position": [str(x) for x in position]}, separators=(",", ":"))
    return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def decode(request: dict, cursor: str | None) -> list[str] | None:
    """The position, or None without a cursor; one from another request is stale."""
    if not cursor:
        return None
    try:
        body = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        mark, position = body["fingerprint"], body["position"]
    except (ValueError, KeyError, TypeError) as e:
        raise InvalidFilter("the cursor cannot be read") from e
    if mark != fingerprint(request):
        raise InvalidFilter("the cursor belongs to another request")
    return position


def after(keys: list[tuple[Column, bool]], position: list) -> Column:
    """Rows past `position`; keys are (column, descending), and each is compared in its own type."""
    steps, same = [], F.lit(True)
    for (column, falling), value in zip(keys, position, strict=True):
        at = F.lit(value)
        steps.append(same & ((column < at) if falling else (column > at)))
        same = same & (column == at)
    return reduce(lambda a, b: a | b, steps)


def page(df: DataFrame, keys: list[tuple[Column, bool]], limit: int, position: list | None = None) -> DataFrame:
    """The next `limit` + 1 rows, the last of them only to show that there are more: a top-k, never a full sort."""
    rest = df if position is None else df.filter(after(keys, position))
    return rest.orderBy(*[c.desc_nulls_last() if falling else c.asc_nulls_last() for c, falling in keys]).limit(limit + 1)


def cut(rows: list[Any], limit: int) -> tuple[list[Any], bool]:
    return rows[:limit], len(rows) > limit

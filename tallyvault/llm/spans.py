"""Digest columns shared by the span-finding operators: `kind:start:end` lists and their hash."""

from __future__ import annotations

import hashlib

#: (kind, start, end) in code points, end exclusive
Span = tuple[str, int, int]


def listed(spans: list[Span], kinds: tuple[str, ...]) -> str:
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2])))


def digest(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(listed(spans, kinds).encode()).hexdigest()

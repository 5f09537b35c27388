"""Secrets in whole texts.

Base: assignments of a named secret, access key ids, and long hexadecimal strings.

Method: token efficiency.  A vocabulary of natural text needs few tokens for words and
many for random strings, so a string of few characters a token is taken for a secret.
Only unbroken strings of at least `LEAST` characters, `DISTINCT` of them different, are
candidates.  How few are needed hangs on what the string is made of (`MOST_RATIO`): letters
without digits are words more often than not.  Words joined to a random string raise the
ratio of the whole, so a string that is not taken as a whole is tried in parts: each part
between joints, then neighbouring parts together.  Known digests (hexadecimal of a usual
digest length), UUIDs and identifiers (words joined by `-`, `_`, `/` or `.`, and numbers)
are excluded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvault.llm.spans import Span
from tallyvault.llm.tokens import VOCABULARY, encoder

KINDS = ("assign", "access", "hex", "random")
LEAST = 20
DISTINCT = 8
#: Characters a token up to which a string is random: of letters and digits, of letters in both cases, of letters in one case.
MOST_RATIO = {"mixed": 2.0, "cases": 1.9, "case": 1.85}
DIGESTS = (32, 40, 56, 64, 96, 128)
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMED = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
# a run that is too short fails wherever it is begun, so the least length may stand in the pattern
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.-]{{{LEAST},}}")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_PART = re.compile(r"[A-Za-z]+|[0-9]+")
_JOINED = re.compile(rf"{_UUID.pattern}(?![A-Za-z0-9])|[A-Za-z0-9]+")


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind, without overlap within a kind; failing matches are dropped."""
    out = []
    if _NAMED.search(text):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def known(string: str) -> bool:
    """Digests and UUIDs."""
    return bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", string) and len(string) in DIGESTS or _UUID.fullmatch(string))


def plain(string: str) -> bool:
    """Strings whose parts between joints are each a word or a number."""
    return all(_PART.fullmatch(p) for p in re.split(r"[-_/.=+]+", string) if p)


def mixes(string: str) -> bool:
    return any(c.isdigit() for c in string) and any(c.isalpha() for c in string)


def random_string(string: str, ids) -> bool:
    """Whether a string, its joints included, has few characters a token."""
    if len(string) < LEAST or string.isdigit() or known(string) or len(set(string)) < DISTINCT:
        return False
    kind = "mixed" if mixes(string) else "case" if string in (string.lower(), string.upper()) else "cases"
    return len(string) <= MOST_RATIO[kind] * len(ids(string))


def joined_spans(string: str, ids) -> list[tuple[int, int]]:
    """Random parts of a string of parts between joints.

    Parts of at least `LEAST` characters are tested alone.  Between those that are taken, and
    between digests and UUIDs, so are the shortest groups of neighbours from and up to each
    part, if parts that mix letters with digits make up half of the group.
    """
    out, rows = [], [[]]
    for m in _JOINED.finditer(string):
        part = m[0]
        if random_string(part, ids):
            out.append(m.span())
        elif not (len(part) >= LEAST and known(part)):
            rows[-1].append((*m.span(), 0 if _PART.fullmatch(part) else len(part)))
            continue
        rows.append([])
    for row in rows:
        groups, i = set(), 0
        for j, (_, end, _) in enumerate(row):
            while i <= j and end - row[i][0] >= LEAST:  # from each part to the first that is far enough
                groups.add((i, j))
                i += 1
            if i:
                groups.add((i - 1, j))  # up to each part, from the last that is far enough
        for i, j in sorted(groups):
            a, b = row[i][0], row[j][1]
            part = string[a:b]
            if i < j and 2 * sum(n for *_, n in row[i : j + 1]) >= len(part) and not plain(part) and mixes(part) and random_string(part, ids):
                out.append((a, b))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and a < merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    return merged


def random_spans(text: str, ids) -> list[Span]:
    out = []
    for m in _CANDIDATE.finditer(text):
        s = m[0].strip(".=-/_+")
        if len(s) < LEAST or known(s):
            continue
        at = m.start() + m[0].index(s)
        whole = not plain(s) and mixes(s) and random_string(s, ids)
        out += [("random", at + a, at + b) for a, b in ([(0, len(s))] if whole else joined_spans(s, ids))]
    return out


def secrets(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Spans of secrets in each row of `docs`; no shuffle.

    doc_id, text, and base and added: arrays of (kind, start, end).  Null texts are
    empty, and empty texts have no spans.  Repeated rows and null ids come out as they
    are; other columns are ignored.
    """
    shape = "array<struct<kind: string, start: int, end: int>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = encoder(vocabulary).ids
        for batch in batches:
            found = [(base_spans(t), random_spans(t, ids)) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"),
                "base": [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in b] for b, _ in found],
                "added": [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in a] for _, a in found],
            })

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInPandas(run, f"doc_id long, base {shape}, added {shape}")


def digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Counts of the base spans by kind, their hash, and all spans as text, of each row of `docs`."""
    return summed(secrets(docs, vocabulary), KINDS, ("assign", "access", "hex"))


def summed(found: DataFrame, kinds: tuple[str, ...], base_kinds: tuple[str, ...]) -> DataFrame:
    """Digest columns of doc_id, base and added, in SQL; kinds in the order that ties at a start have."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])

    def text(spans):
        keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), rank[s["kind"]].alias("r"), s["end"].alias("b"), s["kind"].alias("k")))
        return F.array_join(F.transform(F.sort_array(keyed), lambda s: F.concat_ws(":", s["k"], s["a"], s["b"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, base_kinds), F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(F.concat("base", "added")).alias("spans"))


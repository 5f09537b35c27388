"""Personal data in whole texts.

Base: e-mail addresses, IPv4 addresses, card numbers and phone numbers as written.

Method: offset-preserving deobfuscation.  A transducer rewrites a text and keeps, for
each character it writes, the span of source characters it stands for: look-alike
letters, full-width forms and digits of other scripts become ASCII, invisible characters
go, runs of spelled digits (after `plus`, perhaps) become digits, and `at` and `dot` in their disguises become `@` and `.`, as do the codes of HTML and URLs.  The
detectors run over what it writes, and the spans they find are mapped back.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvault.llm.secrets import summed
from tallyvault.llm.spans import Span

KINDS = ("email", "ip", "card", "phone")
# fixed values: letters that look like an ASCII letter
LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ѕ": "s", "у": "y", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X",
    "Ѵ": "V", "ѵ": "v", "ԛ": "q", "Ԛ": "Q", "ԝ": "w", "Ԝ": "W", "У": "Y", "Ү": "Y", "ү": "y", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "Ԁ": "D", "Ԍ": "G", "Ӏ": "I",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "γ": "y", "ε": "e", "η": "n", "σ": "o", "ω": "w",
    "ı": "i", "ȷ": "j", "ɡ": "g", "ɑ": "a", "ɩ": "i", "ʟ": "L", "ɴ": "N", "ʀ": "R", "ʏ": "Y", "ɪ": "I", "ʙ": "B", "ʜ": "H", "ᴀ": "A", "ᴄ": "C", "ᴅ": "D", "ᴇ": "E", "ᴊ": "J", "ᴋ": "K", "ᴍ": "M", "ᴏ": "O", "ᴘ": "P", "ᴛ": "T", "ᴜ": "U", "ᴠ": "V", "ᴡ": "W", "ᴢ": "Z",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "զ": "q", "ց": "g", "ѡ": "w", "ⅼ": "l", "ꓲ": "I",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "‐": "-", "‑": "-", "‒": "-", "–": "-", "。": ".", "․": ".", "·": ".", "•": ".", "∙": ".", "⋅": ".", "−": "-", "⁃": "-", "﹣": "-",
}
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
LEAST_DIGIT_WORDS = 4
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# each run of digits ends where its own last digit is, so a start within the run fails or ends as its beginning does
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORDS = "|".join(DIGIT_WORDS)
_SPELLED = re.compile(rf"(?<![A-Za-z])(?:plus[\x20,-]+)?(?:{_WORDS})(?:[\x20,-]+(?:{_WORDS}))+(?![A-Za-z])", re.IGNORECASE | re.ASCII)
_DIGIT_WORD = re.compile(rf"(?:plus|{_WORDS})", re.IGNORECASE | re.ASCII)
# the spaces around a bracketed disguise are taken in by `around`, as a pattern that begins with them would be quadratic
_AT = re.compile(r"[\[({<]\x20*+(?:at|@)\x20*+[\])}>]", re.IGNORECASE | re.ASCII)
_DOT = re.compile(r"[\[({<]\x20*+(?:dot|\.)\x20*+[\])}>]", re.IGNORECASE | re.ASCII)
# the signs as HTML and URLs write them, with a letter or digit at both sides
_CODED = re.compile(r"(?<=[A-Za-z0-9_%+-])(?:(&\#0{0,5}64;|&\#x0{0,5}40;|&commat;|%40)|(&\#0{0,5}46;|&\#x0{0,5}2e;|&period;|%2e))(?=[A-Za-z0-9])", re.IGNORECASE | re.ASCII)
# without brackets, only as part of a whole address
_SPOKEN = re.compile(r"(?<![A-Za-z0-9._%+@-])([A-Za-z0-9][A-Za-z0-9._%+-]*+)(\x20++at\x20++)([A-Za-z0-9-]++)((?:\x20++dot\x20++[A-Za-z0-9-]++)+)", re.IGNORECASE | re.ASCII)
_SPOKEN_DOT = re.compile(r"\x20++dot\x20++", re.IGNORECASE | re.ASCII)
_SPOKEN_IP = re.compile(r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\x20++dot\x20++[0-9]{1,3}){3}(?![A-Za-z0-9])", re.IGNORECASE | re.ASCII)


def around(text: str, start: int, end: int, least: int) -> tuple[int, int]:
    """A span widened over the spaces at both sides, but not before `least`."""
    while start > least and text[start - 1] == " ":
        start -= 1
    while end < len(text) and text[end] == " ":
        end += 1
    return start, end


def emails(text: str) -> Iterator[Span]:
    """As the pattern `[A-Za-z0-9._%+-]+@...` finds them, but from each `@` outwards: linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        if m:
            while start > end and text[start - 1] in _LOCAL_CHARS:
                start -= 1
        if m and start < at:
            yield "email", start, m.end()
            end = m.end()
        at = text.find("@", max(end, at + 1))


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind, without overlap within a kind; failing matches are dropped."""
    out: list[Span] = list(emails(text))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m.groups())]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _table() -> dict[int, str]:
    """Look-alikes, decimal digits of any script, and every code point whose compatibility form is one ASCII letter, digit or sign."""
    out = {}
    for i in range(128, 0x110000):
        c = unicodedata.normalize("NFKC", chr(i))
        if len(c) == 1 and " " < c < "\x7f":
            out[i] = c
        elif unicodedata.category(chr(i)) == "Nd":
            out[i] = str(unicodedata.decimal(chr(i)))
    return out | {ord(k): v for k, v in LOOKALIKES.items()}


_FOLDS = _table()
# within the basic plane, where a set of characters is a table; beyond it every character is looked at
_ODD = re.compile(f"[{''.join(re.escape(chr(i)) for i in sorted(_FOLDS) if i < 65_536)}{INVISIBLE}]")
_BEYOND = re.compile("[\U00010000-\U0010ffff]")
_HIDDEN = re.compile(f"[{INVISIBLE}]")


def normalised(text: str) -> tuple[str, list[tuple[int, int, int]]] | None:
    """The rewritten text and its pieces, (start written, start in source, end in source); None where nothing is rewritten.

    Within a piece whose two lengths agree characters correspond one to one; otherwise the
    whole piece stands for the whole source span.
    """
    folded = text.translate(_FOLDS) if not text.isascii() and (_ODD.search(text) or _BEYOND.search(text)) else text
    edits: list[tuple[int, int, str]] = [(m.start(), m.end(), "") for m in _HIDDEN.finditer(folded)] if folded is not text or _HIDDEN.search(text) else []
    lower = folded.lower()
    dots = "dot" in lower
    if "&" in folded or "%" in folded:
        edits += [(*m.span(), "@" if m[1] else ".") for m in _CODED.finditer(folded)]
    if any(c in folded for c in "[({<"):
        found = sorted([(*m.span(), "@") for m in _AT.finditer(folded)] + [(*m.span(), ".") for m in _DOT.finditer(folded)])
        least = 0
        for start, end, sign in found:
            start, end = around(folded, start, end, least)
            edits.append((start, end, sign))
            least = end
    if dots and "at" in lower:
        for m in _SPOKEN.finditer(folded):
            edits.append((m.start(2), m.end(2), "@"))
            edits += [(d.start(), d.end(), ".") for d in _SPOKEN_DOT.finditer(folded, m.start(4), m.end(4))]
    if dots:
        for m in _SPOKEN_IP.finditer(folded):
            edits += [(d.start(), d.end(), ".") for d in _SPOKEN_DOT.finditer(folded, m.start(), m.end())]
    for m in _SPELLED.finditer(folded):
        words = list(_DIGIT_WORD.finditer(m[0]))
        if len(words) >= LEAST_DIGIT_WORDS:
            for i, w in enumerate(words):
                end = m.start() + (words[i + 1].start() if i + 1 < len(words) else w.end())
                edits.append((m.start() + w.start(), end, DIGIT_WORDS.get(w[0].lower(), "+")))
    if not edits and folded == text:
        return None
    out, pieces, at, written = [], [], 0, 0

    def put(string: str, start: int, end: int) -> None:
        nonlocal written
        if string:
            pieces.append((written, start, end))
            out.append(string)
            written += len(string)

    for start, end, string in sorted(edits):
        if start < at:
            continue
        put(folded[at:start], at, start)
        put(string, start, end)
        at = end
    put(folded[at:], at, len(folded))
    pieces.append((written, len(text), len(text)))
    return "".join(out), pieces


def back(pieces: list[tuple[int, int, int]], keys: list[int], start: int, end: int) -> tuple[int, int]:
    """The source span of a written span; `keys` are the places where the pieces start."""

    def place(i: int, last: bool) -> int:
        k = bisect.bisect_right(keys, i) - 1
        w, a, b = pieces[k]
        if keys[k + 1] - w == b - a:
            return a + i - w + last
        return b if last else a

    return place(start, False), place(end - 1, True)


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Identifiers found only after rewriting; those that lie within a base span of their kind add nothing, longer ones do."""
    got = normalised(text)
    if got is None:
        return []
    written, pieces = got
    keys = [p[0] for p in pieces]
    own: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    for kind, a, b in sorted(base):
        own[kind].append((a, b))
    out = []
    for kind, a, b in base_spans(written):
        start, end = back(pieces, keys, a, b)
        at = bisect.bisect_right(own[kind], (start, len(text))) - 1
        if at < 0 or own[kind][at][1] < end:
            out.append((kind, start, end))
    return out


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and added spans (kind, start, end) of each row of `docs`; no shuffle.

    Null texts are empty, and empty texts have no spans.  Repeated rows and null ids come
    out as they are; other columns are ignored.
    """
    shape = "array<struct<kind: string, start: int, end: int>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(b := base_spans(t), added_spans(t, b)) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"),
                "base": [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in b] for b, _ in found],
                "added": [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in a] for _, a in found],
            })

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInPandas(run, f"doc_id long, base {shape}, added {shape}")


def digests(docs: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, their hash, and all spans as text, of each row of `docs`."""
    return summed(personal_data(docs), KINDS, KINDS)


def masked(text: str | None) -> str | None:
    """The text with each span, base or added, replaced by its kind in angle brackets; overlapping spans become one."""
    if not text:
        return text
    base = base_spans(text)
    out, at = [], 0
    for a, b, kind in sorted((a, -b, k) for k, a, b in [*base, *added_spans(text, base)]):
        if a >= at:
            out.append(text[at:a] + f"<{kind}>")
        at = max(at, -b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame) -> DataFrame:
    """`docs` with personal data masked in `text`; every row and every other column stays as it is.  No shuffle.

    Null and empty texts stay so.  A column n_chars, if there is one, follows the text.
    """

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([masked(t) for t in texts], dtype=object)

    out = docs.withColumn("text", F.pandas_udf(run, "string")(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

"""Language of whole texts.

Method: cross-parsing entropy.  For each language a suffix automaton of labelled text
gives, at any place of another text, the longest match with the labelled text; a text
is parsed into such longest matches from left to right.  The language that needs the
fewest phrases for each character wins.

Texts are normalised first: lower case, and every run of characters that are not
letters becomes one gap.  A letter that the labelled text of a language lacks is a phrase
of its own and counts twice, for an escape and the letter.

A text is parsed in segments of `SEGMENT` characters by many lanes at once, each from its
own start, and the parses are then stitched: the parse that comes from the left goes on
into the next segment until it begins a phrase where that segment's own parse does, and
from there on both are the same.  So the result is the exact parse of the whole text.

An automaton's transitions on the commonest characters are a table of state by character;
those on all other characters are looked up in a sorted list, so no character is left out.
An entry without a match holds the state after the character alone and what a new phrase
costs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the labelled sample that is fitted: rows and characters of each language, and of all languages together; and how many languages are learned.
SAMPLE_DOCS = 300
SAMPLE_CHARS = 40_000
LEAST_DOCS = 10
ALL_DOCS = 30_000
ALL_CHARS = 1_000_000
MOST_LANGUAGES = 1_000
SEGMENT = 256
#: Characters of the table's columns, and its entries; a trade of memory for time without effect on results.
COLUMNS = 96
TABLE = 1 << 26
BATCH_CHARS = 1 << 21
UNKNOWN = "und"
#: A text is rejected if its winner needs more than so many phrases a character, beyond the first few, or, of languages that need more themselves, more than `SPARE` times what their held-back labelled texts need.
MOST_PHRASES, FIRST_PHRASES, SPARE = 0.5, 3, 1.25
_COST = 29
_STATE = (1 << _COST) - 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """True at each code point that is a letter."""
    return np.array([chr(i).isalpha() if not 0xD800 <= i <= 0xDFFF else False for i in range(0x110000)])


def points(text: str) -> np.ndarray:
    """Code points of the normalised text: letters in lower case, 32 for each run of others."""
    p = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    p = np.where(_letters()[p], p, np.uint32(32))
    gap = p == 32
    return p[np.concatenate(([True], ~(gap[1:] & gap[:-1])))] if len(p) else p


def automaton(codes: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions and suffix links of the suffix automaton of a sequence."""
    step, link, size, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return step, link


class Model:
    """The automata of all languages, stacked, and each language's rate of phrases at which a text is rejected."""

    def __init__(self, samples: dict[str, list[str]], held_back: dict[str, list[str]] | None = None, columns: int = COLUMNS):
        self.langs = sorted(samples)
        parts = {k: np.concatenate([np.append(points(t), np.uint32(32)) for t in samples[k]] or [np.empty(0, np.uint32)]) for k in self.langs}
        seen, n = np.unique(np.concatenate([*parts.values(), np.array([32], np.uint32)]), return_counts=True)
        self.letters = seen[np.lexsort((seen, -n))]  # the commonest first; a letter's code is its place from 1, and 0 is any other
        code = {int(c): i + 1 for i, c in enumerate(self.letters)}
        self.codes = len(self.letters) + 1
        steps = [automaton([code[int(c)] for c in parts[k]])[0] for k in self.langs]
        states = sum(map(len, steps))
        self.width = max(1, min(columns + 1, self.codes, TABLE // max(1, states)))
        table = np.empty((states, self.width), np.int32)
        keys, values, self.roots, at = [], [], [], 0
        for step in steps:
            self.roots.append(at)
            table[at : at + len(step)] = at | 2 << _COST  # a letter that the language lacks
            alone = [(c, t) for c, t in step[0].items() if c < self.width]
            for c, t in alone:
                table[at : at + len(step), c] = (at + t) | 1 << _COST
            for s, out in enumerate(step):
                for c, t in out.items():
                    cost = (not s) << _COST
                    if c < self.width:
                        table[at + s, c] = (at + t) | cost
                    else:
                        keys.append((at + s) * self.codes + c)
                        values.append((at + t) | cost)
            at += len(step)
        self.table = table.ravel()
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int32)[order]
        self.most = np.full(len(self.langs), MOST_PHRASES)
        for k, lang in enumerate(self.langs):
            texts = [p for p in map(points, (held_back or {}).get(lang, ())) if len(p) >= 20]
            if texts:
                self.most[k] = max(MOST_PHRASES, SPARE * float(np.quantile(self.phrases(texts)[:, k], 0.95)))

    @property
    def lookup(self) -> np.ndarray:
        if getattr(self, "_lookup", None) is None:
            out = np.zeros(0x110000, np.int32)
            out[self.letters] = np.arange(1, self.codes)
            self._lookup = out
        return self._lookup

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_lookup"}

    def _next(self, state: np.ndarray, code: np.ndarray, root: int, rare: bool) -> np.ndarray:
        """State and cost after a character each."""
        if not rare:
            return self.table[state * self.width + code]
        common = code < self.width
        out = self.table[state * self.width + np.where(common, code, 0)]
        other = np.flatnonzero(~common)
        if len(other) and len(self.keys):
            for base, cost in ((root, 1 << _COST), (state[other].astype(np.int64), 0)):  # what follows the state comes last and counts
                want = base * self.codes + code[other]
                at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
                hit = self.keys[at] == want
                out[other[hit]] = self.values[at[hit]] if cost == 0 else self.values[at[hit]] & _STATE | cost
        return out

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases a character of each text (given as normalised code points) by language."""
        lanes = np.array([-(-len(t) // SEGMENT) for t in texts], np.int64)
        total = int(lanes.sum())
        out = np.zeros((len(texts), len(self.langs)))
        if not total or not self.langs:
            return out
        grid = np.full(total * SEGMENT, -1, np.int32)
        at = 0
        for t, n in zip(texts, lanes, strict=True):
            grid[at * SEGMENT : at * SEGMENT + len(t)] = self.lookup[t]
            at += n
        grid = grid.reshape(total, SEGMENT)
        length = (grid >= 0).sum(1)
        order = np.argsort(-length, kind="stable")
        columns = np.ascontiguousarray(grid[order].T)
        alive = np.searchsorted(-length[order], -np.arange(SEGMENT), side="left")  # lanes with a character at each step
        rare = [bool((columns[i] >= self.width).any()) for i in range(SEGMENT)]
        owner = np.repeat(np.arange(len(texts)), lanes)
        follows = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # lanes that go on with a text
        for k, root in enumerate(self.roots):
            costs = np.zeros((SEGMENT, total), np.uint8)
            state = np.full(total, root, np.int32)
            for i in range(SEGMENT):
                m = alive[i]
                if not m:
                    break
                s = self._next(state[:m], columns[i, :m], root, rare[i])
                costs[i, :m] = s >> _COST
                state[:m] = s & _STATE
            own, last = np.empty((total, SEGMENT), np.uint8), np.empty(total, np.int32)
            own[order], last[order] = costs.T, state
            spent = own.sum(1, dtype=np.int64)
            if len(follows):
                spent = self._stitched(grid, length, own, last, spent, follows, root)
            out[:, k] = np.bincount(owner, spent, len(texts))
        return out / np.maximum([len(t) for t in texts], 1)[:, None]

    def _stitched(self, grid: np.ndarray, length: np.ndarray, own: np.ndarray, last: np.ndarray, spent: np.ndarray, follows: np.ndarray, root: int) -> np.ndarray:
        """What each lane costs in the exact parse, from what it costs when parsed from its own start."""
        spent = spent.copy()
        came = last.copy()  # the exact parse's state at the end of each lane
        lane, state = follows, last[follows - 1]
        extra, gone = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)  # what the parse from the left costs, and what it replaces
        loose: list[tuple[int, int]] = []  # lanes it went through without meeting the lane's own parse, with its state then
        for i in range(SEGMENT):
            ended = length[lane] <= i
            if ended.any():
                loose += zip(lane[ended].tolist(), state[ended].tolist(), strict=True)
                spent[lane[ended]] = extra[ended]
                lane, state, extra, gone = (x[~ended] for x in (lane, state, extra, gone))
            if not len(lane):
                break
            code = grid[lane, i]
            s = self._next(state, code, root, bool((code >= self.width).any()))
            cost, mine = s >> _COST, own[lane, i]
            met = (cost > 0) & (mine > 0)
            spent[lane[met]] += extra[met] - gone[met]
            lane, state, extra, gone = lane[~met], (s & _STATE)[~met], (extra + cost)[~met], (gone + mine)[~met]
        loose += zip(lane.tolist(), state.tolist(), strict=True)
        spent[lane] = extra
        # beyond such a lane the parse goes on, a character at a time, until it meets a lane's own
        next_of = set(follows.tolist())
        open_ = dict(loose)
        for at in sorted(open_):
            if at not in open_:
                continue
            state_, j = open_.pop(at), at + 1
            while j in next_of:
                extra_, gone_, met_ = 0, 0, False
                for i in range(int(length[j])):
                    s = self._one(state_, int(grid[j, i]), root)
                    if s >> _COST and own[j, i]:
                        met_ = True
                        break
                    extra_, gone_, state_ = extra_ + (s >> _COST), gone_ + int(own[j, i]), s & _STATE
                open_.pop(j, None)
                whole = int(own[j].sum(dtype=np.int64))
                spent[j] = whole + extra_ - gone_ if met_ else extra_
                if met_:
                    break
                j += 1
        return spent

    def _one(self, state: int, code: int, root: int) -> int:
        if code < self.width:
            return int(self.table[state * self.width + code])
        for base in (state, root):
            at = int(np.searchsorted(self.keys, base * self.codes + code))
            if at < len(self.keys) and self.keys[at] == base * self.codes + code:
                return int(self.values[at]) if base == state else int(self.values[at]) & _STATE | 1 << _COST
        return root | 2 << _COST


def fit(labelled: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on a bounded sample of `labelled` (doc_id, text, lang), spread evenly over each language by a hash of the row.

    A sample has whole rows only, of any length: of about `docs` rows of each language, in
    the order of their hashes, those that still fit into `chars` characters.  Of a language
    none of whose rows fit, the shortest of them is taken as a whole.  Every tenth is held back, within as
    many characters, to learn what texts of the language need.  Rows without text or
    language are no labels; repeated rows are one.  A label is learned however few rows it has, up to
    MOST_LANGUAGES labels, those with most rows.  With many languages `docs` and `chars`
    shrink, so that all have ALL_DOCS and ALL_CHARS together.  Without labels the model has no language, and every text
    is `und`.  To the driver come one number a language, hash and length of the sampled
    rows, and the sample.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & (F.char_length(F.col("text").cast("string")) > 0)).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return Model({})
    docs, chars = max(LEAST_DOCS, min(docs, ALL_DOCS // len(counts))), min(chars, ALL_CHARS // len(counts))
    spark = labelled.sparkSession
    shares = spark.createDataFrame([(k, min(1.0, docs / n)) for k, n in counts.items()], "lang string, share double")
    near = rows.join(F.broadcast(shares), "lang").filter(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < F.col("share"))
    lengths: dict[str, list[tuple[int, int]]] = {k: [] for k in counts}
    for r in near.groupBy("lang", "h").agg(F.min(F.char_length("text")).alias("n")).collect():
        lengths[r["lang"]].append((r["h"], r["n"]))
    for k, found in lengths.items():
        if not found:  # a hash rarely leaves a small language without any
            least = rows.filter(F.col("lang") == k).agg(F.min(F.struct("h", F.char_length("text").alias("n"))).alias("r")).first()["r"]
            found.append((least["h"], least["n"]))
    chosen: dict[tuple[str, int], bool] = {}  # whether the row is held back
    for k, found in lengths.items():
        used = {False: 0, True: 0}
        for i, (h, n) in enumerate(sorted(found)):
            back = i % 10 == 9
            if used[back] + n <= chars:
                chosen[k, h] = back
                used[back] += n
        if not used[False]:
            chosen[k, min(found, key=lambda x: (x[1], x[0]))[0]] = False
    wanted = spark.createDataFrame([(k, h, back) for (k, h), back in chosen.items()], "lang string, h long, back boolean")
    texts = rows.join(F.broadcast(wanted), ["lang", "h"]).groupBy("lang", "h", "back").agg(F.min("text").alias("text"))
    samples: dict[str, list[str]] = {k: [] for k in counts}
    held: dict[str, list[str]] = {k: [] for k in counts}
    for r in sorted(texts.collect(), key=lambda r: r["h"]):
        (held if r["back"] else samples)[r["lang"]].append(r["text"])
    return Model(samples, held)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), phrases and chars of each row of `docs`; no shuffle.

    phrases is what the winner needs and chars the length of the normalised text.  score is
    1 less the winner's phrases over the runner-up's, 1 if there is only one language.  Null texts and texts without a letter are `und` with score 0, and so is
    everything under a model without languages.  Ties go to the first language by name.
    Repeated rows and null ids come out as they are; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            langs, scores, phrases, chars, held, held_chars = [], [], [], [], [], 0

            def flush(held: list[np.ndarray], langs: list[str], scores: list[float], phrases: list[int], chars: list[int]) -> None:
                cost = m.phrases(held)
                known = np.array([bool((t != 32).any()) for t in held]) if m.langs else np.zeros(len(held), bool)
                best = cost.argmin(1) if m.langs else np.zeros(len(held), int)
                for i, ok in enumerate(known):
                    two = np.sort(cost[i])[:2] if ok else ()
                    langs.append(m.langs[best[i]] if ok else UNKNOWN)
                    scores.append(0.0 if not ok else 1.0 if len(two) < 2 else float(1 - two[0] / two[1]))
                    phrases.append(round(float(cost[i].min()) * len(held[i])) if ok else 0)
                    chars.append(len(held[i]))

            for text in batch["text"]:
                held.append(points(text) if isinstance(text, str) else np.empty(0, np.uint32))
                held_chars += len(held[-1])
                if held_chars >= BATCH_CHARS:
                    flush(held, langs, scores, phrases, chars)
                    held, held_chars = [], 0
            if held:
                flush(held, langs, scores, phrases, chars)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": langs, "score": scores, "phrases": phrases, "chars": chars})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, lang_pred string, score double, phrases long, chars long")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` whose text is in a learned language, with all their columns; the prediction is not stored.

    Rejected are null texts, texts without a letter, and texts that no language's labelled
    text explains (see MOST_PHRASES).  Repeated rows are judged alike.  Under a model without
    languages nothing but the first two is rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.Series:
        m, out, held, size = shared.value, [], [], 0

        def flush(held: list[np.ndarray]) -> list[bool]:
            fine = np.ones(len(held), bool)
            if m.langs:
                cost, n = m.phrases(held), np.array([len(t) for t in held])
                fine = cost.min(1) * n <= m.most[cost.argmin(1)] * n + FIRST_PHRASES
            return (fine & [bool((t != 32).any()) for t in held]).tolist()

        for text in texts:
            held.append(points(text) if isinstance(text, str) else np.empty(0, np.uint32))
            size += len(held[-1])
            if size >= BATCH_CHARS:
                out += flush(held)
                held, size = [], 0
        return pd.Series(out + (flush(held) if held else []), dtype=bool)

    return docs.filter(F.pandas_udf(run, "boolean")(F.col("text").cast("string")))

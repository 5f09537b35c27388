"""Operators on whole datasets (lines, late arrivals, manifests), against DuckDB or brute force."""

import collections
import datetime as dt
import hashlib
import math
import os
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyvault.llm import lines, merkle, oracles, overwrite, registry
from tests.conftest import compared

# lines


def test_lines_that_ten_documents_share(docs, duck_of):
    shared = ["  Terms of Use\t", "TERMS of use", "\x0bterms OF use\r", "terms of use"]
    rows = [(i, f"own {i}\n{shared[i % 4]}\nÉtat\nétat {i % 3}\n\n  \n") for i in range(12)]
    rows += [(100, None), (101, ""), (102, "\n"), (None, "terms of use"), (None, None), (7, "nine\nnine"), *[(200 + i, "nine") for i in range(8)]]
    rows += [(300, "thrice, one row\nof one id")] * 10
    table = docs(rows)
    ours, theirs = compared(lines.digests(table), duck_of(table), oracles.LINES)
    assert ours == theirs
    kept = {(r["doc_id"], r["text"]) for r in lines.deduplicated(table).collect()}
    assert (3, "own 3\nétat 0\n\n  \n") in kept and (102, "\n") in kept and (101, "") in kept and (100, None) in kept and (None, "") in kept
    assert (300, "") in kept and (7, "nine\nnine") in kept  # ten equal rows are ten documents, and nine documents are not enough


def test_lines_of_odd_rows(odd, duck_of):
    ours, theirs = compared(lines.digests(odd), duck_of(odd.select("doc_id", "text")), oracles.LINES)
    assert ours == theirs
    assert lines.deduplicated(odd).columns == odd.columns and lines.digests(odd.limit(0)).isEmpty()


def test_a_text_of_many_lines(docs):
    long = "\n".join(f"line {i % 30_000}" for i in range(40_000))
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in lines.digests(docs([(i, f"{long}\n{i}") for i in range(11)] + [(99, "\n" * 100_000)])).collect()}
    assert got == {i: (40_001, 40_000) for i in range(11)} | {99: (100_001, 0)}


def test_runs_are_levelled_and_reopened(spark, docs, tmp_path):
    def batch(texts):
        return docs(list(enumerate(texts))).select(lines.hashes(F.col("text")).alias("hashes"))

    runs = lines.Runs(spark, str(tmp_path / "runs"), 3, least=4, fanout=2)
    counts = collections.Counter()
    for b in range(7):
        texts = [f"a{b}\nboth", "both\nboth", f"b{b % 2}"] + ["hot"] * (5 if b == 0 else 1)
        counts.update(line for t in texts for line in set(t.split("\n")))
        runs.add(batch(texts))
        sizes = [len(level) for level in runs.levels]
        assert max(sizes) < 2 and sum(n << i for i, n in enumerate(sizes)) == b + 1  # as a binary counter
        known = {r["line"] for r in runs.common().collect()}
        assert known == {hashlib.md5(k.encode()).hexdigest() for k, n in counts.items() if n >= 4}
    again = lines.Runs.reopen(spark, str(tmp_path / "runs"), 3, least=4, fanout=2)
    assert again.levels == runs.levels and {r["line"] for r in again.common().collect()} == known
    for run in again.tables():  # sorted within buckets, and "hot" is not counted any more
        assert run.groupBy("line").count().filter("count > 1").isEmpty()
    assert sum(t.filter(F.col("line") == hashlib.md5(b"hot").hexdigest()).agg(F.sum("docs")).first()[0] or 0 for t in again.tables()) == 5


# late arrivals

EPOCH = dt.datetime(1970, 1, 1)
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"


def micros(t):
    return None if t is None else (t - EPOCH) // dt.timedelta(microseconds=1)


def files(rows):
    """What op12's contract asks for, in memory: rows of its result but for paths."""
    size, day_long, cut, everything = 1 + len(rows) // 1100, 86_400_000_000, micros(dt.datetime(2024, 3, 20)), []
    for r in rows:
        r = (*r[:4], micros(r[4]), micros(r[5]), r[6])
        everything.append(r)
        h = zlib.crc32(str(r[0]).encode())
        if r[0] is not None and r[4] is not None and h % 3 == 0 and r[4] // day_long % 4 == 0:
            everything.append((*r[:3], None if r[3] is None else r[3] + 1, r[4] + h % 2 * day_long, None if r[5] is None else r[5] + (1 + h % 97) * day_long, r[6]))

    def day(r):
        return -1 if r[4] is None else r[4] // day_long

    def latest(some):
        best = {}
        for r in some:
            k = (r[5] is not None, r[5] or 0, tuple((v is not None, str(v)) for v in r))
            if r[0] not in best or k > best[r[0]][0]:
                best[r[0]] = (k, r)
        return {i: r for i, (_, r) in best.items()}

    early, final = latest(r for r in everything if r[5] is not None and r[5] < cut), latest(everything)
    touched = {d for i, r in final.items() if r[5] is None or r[5] >= cut for d in ([day(r), day(early[i])] if i in early else [day(r)])}
    by, out, text = collections.defaultdict(list), [], lambda v: "" if v is None else str(v)
    for r in final.values():
        by[day(r)].append(r)
    for d, own in by.items():
        own.sort(key=lambda r: (r[4] is not None, r[4] or 0, r[0] is not None, r[0] or 0))
        for k in range(0, len(own), size):
            part = own[k : k + size]
            crc = sum(zlib.crc32(f"{text(r[0])}:{text(r[4])}:{text(r[5])}".encode()) for r in part)
            cents = sum(0 if r[3] is None else math.floor(100 * r[3] + 0.5) for r in part)
            out.append((d, k // size, len(part), cents, crc, hashlib.sha256(",".join(text(r[0]) for r in part).encode()).hexdigest(), d in touched))
    return sorted(out)


def checked(sales):
    got = overwrite.digests(sales).collect()
    want = files([tuple(r) for r in sales.select(*[c.split()[0] for c in SALES.split(", ")]).collect()])
    assert sorted((r["day"], r["file_no"], r["n_rows"], r["cents"], r["rows_crc"], r["ids_sha256"], r["rewritten"]) for r in got) == want
    paths = [r["path"].removeprefix("file://") for r in got]
    there = {os.path.join(at, f) for p in paths[:1] for at, _, found in os.walk(os.path.dirname(os.path.dirname(p))) for f in found if f.endswith(".parquet")}
    assert there == set(paths)
    for r, p in zip(got, paths, strict=True):
        rows = pq.ParquetFile(p).read()
        assert rows.column_names == sales.columns and r["columns"] == ",".join(sales.columns)
        assert hashlib.sha256(",".join("" if v is None else str(v) for v in rows["sale_id"].to_pylist()).encode()).hexdigest() == r["ids_sha256"]
    return got


def test_late_arrivals_of_the_sales(spark, sf_dir):
    got = checked(registry.table(spark, sf_dir, "sales"))
    assert {r["rewritten"] for r in got} == {True, False}


def odd_sales():
    def t(*a):
        return dt.datetime(2024, *a)

    rows = [(1, 1, "a", 1.5, t(1, 1), t(1, 2), 1), (1, 1, "b", 2.5, t(1, 1), t(3, 25), 1), (1, 1, "c", 2.5, t(1, 3), t(3, 25), 1)]  # a tie, and a day that empties
    rows += [(None, 1, "c", 2.5, t(1, 3), t(3, 2), 1), (None, 2, "d", 2.5, t(1, 3), t(3, 19, 23, 59, 59), 1), (2, *[None] * 6), (2, *[None] * 6), (3, 1, "x", -0.5, None, t(1, 1), 2)]
    return [*rows, (4, 1, "x", 0.005, t(1, 3), None, 2), (5, 1, "x", 7.0, dt.datetime(1969, 12, 30, 5, 6, 7, 123456), t(2, 2), 2)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_late_arrivals_of_odd_rows(spark, zone):
    """Nulls, ties, repeated rows, days without rows at the end, names that clash, and a session of another zone."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        table = spark.createDataFrame(odd_sales(), SALES)
        checked(table)
        for c in ("day", "id", "layout_day", "again", "sold", "place"):
            table = table.withColumn(c, F.lit("x"))
        checked(table)
        assert overwrite.digests(table.limit(0)).isEmpty()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_sale_that_most_rows_have(spark, monkeypatch):
    monkeypatch.setattr(overwrite, "LEAST_HOT", 50)
    hot = [(9, i, "h", float(i), dt.datetime(2024, 2, 1 + i % 20, i % 24), dt.datetime(2024, 1 + i % 5, 3, i % 7), 1) for i in range(2000)]
    checked(spark.createDataFrame(hot + odd_sales(), SALES))
    rows = overwrite.in_micros(spark.createDataFrame(hot, SALES))
    seen = overwrite.winners(rows, 0, 5, micros(dt.datetime(2024, 3, 20)), overwrite.new_folder(spark, "test"), least_hot=50).collect()
    assert len(seen) == 2  # of its 2,000 rows


# manifests


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def manifest(rows):
    """op13's rows by recursion over lists; rows are (doc_id, source, lang, n_chars, text)."""

    def leaf(r):
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def built(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([digest(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
        return levels

    by = collections.defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    levels = {g: built([leaf(r) for r in by[g]]) for g in groups}
    top, out = built([levels[g][-1][0] for g in groups]), []
    for at, g in enumerate(groups):
        for i, r in enumerate(by[g]):
            told = (*r[:3], r[3] + 1, r[4]) if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else r
            now, siblings = leaf(told), []
            for some, place in ((levels[g], i), (top, at)):
                for level in some[:-1]:
                    other = level[place ^ 1 : (place ^ 1) + 1]
                    siblings += other
                    now = digest(*([now, *other] if place % 2 == 0 else [*other, now]))
                    place //= 2
            out.append((r[0], leaf(r), levels[g][-1][0], top[-1][0], digest(*siblings), now, now == top[-1][0]))
    return sorted(map(repr, out))


def proven(docs):
    got = sorted(repr(tuple(r)) for r in merkle.digests(docs).collect())
    assert got == manifest([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    return got


def test_manifest_of_the_documents(spark, sf_dir):
    got = proven(registry.table(spark, sf_dir, "documents"))
    assert any("False" in r for r in got) and any("True" in r for r in got)


def test_manifest_of_odd_rows(spark, odd, duck_of):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, *[None] * 4), (1, *[None] * 4), (2, "", "en", "s", 0), (None, "é ü", "fr", "", 5), (3, "a", None, "x", 1), (4, "b", "zz", "x", 1), (4, "b", "zz", "x", 1), (14, "b", "ü", "x", 1), (15, "b", "", "x", 1)]
    rows += [(20 + i, "t", "zz", "x", 3) for i in range(11)]
    table = spark.createDataFrame(rows, schema)
    proven(table)
    ours, theirs = compared(merkle.digests(table), duck_of(table), oracles.MERKLE)
    assert ours == theirs
    proven(spark.createDataFrame(rows[:1], schema))  # the only leaf is the root
    proven(odd.withColumn("proof", F.lit(1)).withColumn("key", F.lit(2)).withColumn("grp", F.lit(3)).withColumn("place", F.lit(4)))
    assert merkle.digests(table.limit(0)).isEmpty()


def test_a_manifest_without_tampering_verifies(docs, words):
    table = docs([(i, words(i, 5), "s", "abc"[i % 3]) for i in range(40)])
    assert all(r["folded_root"] == r["root"] for r in merkle.manifest(table).collect())
    one = merkle.manifest(table, tampered={"text": F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text"))}).collect()
    assert [r["doc_id"] for r in one if r["folded_root"] != r["root"]] == [7]

"""Operators that look at a whole table, against DuckDB or brute force."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyvault.llm import fingerprint, knn, mixing, near, oracles, registry
from tests.conftest import compared


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_matches_its_sql(spark, sf_dir, duck, name):
    ours, theirs = compared(registry.queries()[name](spark, sf_dir), duck, oracles.ORACLES[name])
    assert ours == theirs


# mixing


def test_mixing_of_skewed_sources(docs, words, duck_of):
    sizes = {"hot": 150, "b": 30, "c": 8, "d": 2}
    table = docs([(i, words(i, 5 + i % 40), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))] + [(None, None, None), (999, "", "d")])
    ours, theirs = compared(mixing.mixed(table), duck_of(table), oracles.MIXING)
    assert ours == theirs
    shares = collections.Counter()
    for r in mixing.mixed(table).collect():
        shares[r["source"]] += r["tokens"]
    total = sum(shares.values())
    goal = mixing.counted(table).agg(F.sum("__tv_tokens")).first()[0]
    assert total <= goal and shares["hot"] < 0.75 * total


def greedy(docs, budget):
    """Copies of each document (key, source, tokens): whole rounds, and of the last one every document in turn that fits."""
    import hashlib

    rows = sorted((r["source"], hashlib.md5(f"{mixing.SEED}/{r['doc_id']}".encode()).hexdigest(), str(r["doc_id"]), r["__tv_tokens"]) for r in mixing.counted(docs).collect())
    totals = collections.Counter()
    for source, _, _, n in rows:
        totals[source] += n
    t = mixing.exponent(sorted(totals.values()), budget)
    z = sum((x / sum(totals.values())) ** t for x in totals.values())
    goals = {s: math.floor((x / sum(totals.values())) ** t / z * budget + 1e-6) for s, x in totals.items()}
    left = {s: goals[s] % totals[s] for s in totals}
    out = {}
    for source, _, key, n in rows:
        out[key] = goals[source] // totals[source] + (n <= left[source])
        left[source] -= n if n <= left[source] else 0
    return {k: n for k, n in out.items() if n}, goals


def test_long_documents_do_not_empty_a_source(docs, words):
    rows = [(i, words(i, 3 + i % 9), "long") for i in range(150)] + [(1000 + i, words(1000 + i, n), "long") for i, n in enumerate((400, 500, 620, 90, 60))] + [(2000 + i, words(2000 + i, 8), "short") for i in range(40)]
    table = docs(rows)
    for budget in (900, 1700, 4100):
        want, goals = greedy(table, budget)
        got = mixing.mixed(table, budget, fill=True).collect()
        assert collections.Counter(str(r["doc_id"]) for r in got) == want
        assert len({(r["doc_id"], r["copy"]) for r in got}) == len(got)
        took = collections.Counter()
        for r in got:
            took[r["source"]] += r["tokens"]
        sums = collections.Counter()
        for r in mixing.counted(table).collect():
            sums[r["source"]] += r["__tv_tokens"]
        for r in mixing.counted(table).collect():  # a document without a copy of the last round does not fit
            gap = goals[r["source"]] - took[r["source"]]
            assert gap >= 0 and (want.get(str(r["doc_id"]), 0) > goals[r["source"]] // sums[r["source"]] or r["__tv_tokens"] > gap)
        assert all(abs(r["realised"] - took[r["source"]] / sum(took.values())) < 1e-6 for r in got)
        assert collections.Counter(str(r["doc_id"]) for r in mixing.resampled(table, budget).collect()) == want
    assert mixing.mixed(table.limit(0), fill=True).isEmpty()


def test_rows_that_are_alike(docs, words, duck_of, monkeypatch):
    """Null and repeated ids, also more than one task deals, are mixed as the SQL mixes them, and resampled within the budget."""
    monkeypatch.setattr(mixing, "CHUNK", 7)
    rows = [(None, words(i % 3, 6), "hot") for i in range(90)] + [(5, words(9, 4), "hot") for _ in range(40)] + [(1000 + i, words(i, 3 + i % 5), "b") for i in range(30)] + [(7, "one two", "c"), (7, "three four", "c"), (7, "five six", "c")]
    table = docs(rows).repartition(5)
    ours, theirs = compared(mixing.mixed(table), duck_of(table), oracles.MIXING)
    assert ours == theirs
    for budget in (100, 700, 1900):
        mix = collections.Counter((r["doc_id"], r["source"], r["tokens"]) for r in mixing.mixed(table, budget, fill=True).collect())
        got = mixing.counted(mixing.resampled(table, budget)).collect()
        assert collections.Counter((r["doc_id"], r["source"], r["__tv_tokens"]) for r in got) == mix
        assert sum(r["__tv_tokens"] for r in got) <= budget


def test_many_sources_are_weighed_where_they_are(docs, words, monkeypatch):
    table = docs([(i, words(i, 4 + i % 30), f"s{i * i % 37}") for i in range(300)])
    few = {r["source"]: (r["weight"], r["goal"]) for r in mixing.targets_of(mixing.alike(table), None, mixing.ENTROPY, 1.2).collect()}
    monkeypatch.setattr(mixing, "COLLECTED", 0)
    many = {r["source"]: (r["weight"], r["goal"]) for r in mixing.targets_of(mixing.alike(table), None, mixing.ENTROPY, 1.2).collect()}
    assert few.keys() == many.keys() and all(abs(few[s][0] - many[s][0]) < 1e-9 and abs(few[s][1] - many[s][1]) <= 1 for s in few)


def test_resampled_rows_come_in_blocks(docs, words):
    table = docs([(i, words(i, 10), "ab"[i % 3 == 0]) for i in range(300)])
    spots = collections.defaultdict(list)
    for r in mixing.mixed(table, fill=True, block_tokens=200).collect():
        spots[r["doc_id"]].append((r["block"], r["position"]))
    assert len({b for s in spots.values() for b, _ in s}) > 3
    parts = mixing.resampled(table, block_tokens=200).select("doc_id").rdd.glom().collect()
    assert collections.Counter(r[0] for part in parts for r in part) == {d: len(s) for d, s in spots.items()}
    seen, checked = {}, 0
    for i, part in enumerate(parts):
        once = [spots[r[0]][0] for r in part if len(spots[r[0]]) == 1]
        checked += len(once)
        assert once == sorted(once) and all(seen.setdefault(block, i) == i for block, _ in once)
    assert checked > 100


def test_exponents():
    assert mixing.exponent([5, 5, 5], 15) == 1.0 and mixing.exponent([7], 7) == 1.0
    t = mixing.exponent([1000, 100, 10], 1110, 0.95, 1e9)
    p = [x**t for x in (1000 / 1110, 100 / 1110, 10 / 1110)]
    h = -sum(x / sum(p) * math.log(x / sum(p)) for x in p)
    assert 0 < t < 1 and abs(h - 0.95 * math.log(3)) < 1e-6
    assert mixing.exponent([1000, 100, 10], 1110, 0.95, 2.0) > t


def test_mixing_of_odd_tables(odd):
    rows = mixing.mixed(odd).collect()
    assert rows and all(r["copy"] >= 1 for r in rows)
    assert sorted(r["position"] for r in rows if r["block"] == 0) == list(range(sum(r["block"] == 0 for r in rows)))
    assert mixing.mixed(odd.limit(0)).isEmpty() and mixing.resampled(odd.limit(0)).isEmpty()
    assert mixing.resampled(odd).columns == odd.columns


# neighbours


def test_neighbours_are_exact(spark, duck_of):
    dice = random.Random(5)
    base = [[dice.gauss(0, 1) for _ in range(16)] for _ in range(120)]
    rows = [(i, v) for i, v in enumerate(base)] + [(200 + i, base[0]) for i in range(60)] + [(300, None), (320, [0.0] * 16), (340, [float("nan")] * 16), (341, [1.0, None] * 8), (342, [float("inf")] * 16), (360, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("dim", F.lit("x"))
    small = knn.nearest(table, "vec_id % 20 = 0", query_block=3, candidate_block=40)
    ours, theirs = compared(small, duck_of(table, "embeddings"), oracles.NEAREST)
    assert ours == theirs and len(ours) > 100
    assert knn.nearest(table.limit(0), "vec_id % 20 = 0").isEmpty()


def test_bounds_hold():
    import numpy as np

    dice = np.random.default_rng(2)
    a, b = dice.normal(size=(40, 24)), dice.normal(size=(50, 24)) * 100
    (qa, sa, na), (qb, sb, nb) = knn.quantised(a), knn.quantised(b)
    rough = (qa.astype(float) @ qb.T.astype(float)) * sa[:, None] * sb[None, :]
    slack = (0.5 * (na[:, None] + nb[None, :]) + 0.25 * 24) * sa[:, None] * sb[None, :]
    assert (abs(a @ b.T - rough) <= slack).all()


# near duplicates


def brute(rows):
    """links and the least linked id of each document."""
    sets = {d: set(near.shingles(t).tolist()) for d, t in rows}
    links = {d: set() for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                    links[a].add(b)
                    links[b].add(a)
    least = {}
    for d in sorted(sets):
        if d not in least:
            todo = [d]
            while todo:
                x = todo.pop()
                if x not in least:
                    least[x] = d
                    todo += links[x]
    return {d: (least[d], len(links[d])) for d in sets}


def edited(text, at):
    parts = text.split()
    parts[at % len(parts)] = f"new{at}"
    return " ".join(parts)


def test_large_groups_lose_no_link(docs, words, monkeypatch):
    monkeypatch.setattr(near, "GROUP_BLOCK", 8)
    monkeypatch.setattr(near, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(near, "BROADCAST_ROWS", 0)
    big, passage = words(1, 120), words(2, 60)
    rows = [(i, edited(big, 17 * i)) for i in range(40)] + [(100 + i, big) for i in range(10)] + [(200 + i, f"{words(50 + i, 60)} {passage}") for i in range(12)]
    rows += [(300 + i, edited(edited(words(9, 60), i), 30 + i)) for i in range(5)] + [(400, "few words"), (401, "few words"), (402, "few others")]
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in near.near_duplicates(docs(rows)).collect()}
    assert got == brute(rows)


def test_near_duplicates_of_odd_tables(odd):
    rows = near.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {(r["class_id"], r["links"]) for r in rows if r["doc_id"] == 7} == {(3, 2)} and {r["class_id"] for r in rows if r["doc_id"] is None} == {None}
    assert {r["links"] for r in rows if r["doc_id"] in (1, 2, 5)} == {0}
    kept = near.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted({(r["doc_id"] or 0, r["text"] or "") for r in odd.filter("doc_id is null or doc_id <> 7").collect()})
    assert near.near_duplicates(odd.limit(0)).isEmpty()


def test_banding_reaches_its_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = near.banding(threshold, 0.999, 256)
        assert bands * rows <= 256 and 1 - (1 - threshold**rows) ** bands >= 0.999


# fingerprints


def test_fingerprints_in_small_ranges(docs, words, duck_of):
    common = [words(1000 + i, 3) for i in range(12)]
    table = docs([(i * 7 % 101, f"{words(i, 10 + i % 5)} {common[i % 12]} {common[i % 5]}") for i in range(60)] + [(500, ""), (501, None), (502, "…"), (None, "last of all"), (8, "one id twice"), (8, "one id twice")])
    lines = oracles.FINGERPRINTS.replace(f"{fingerprint.HIGH} *", "0.2 *")
    ours, theirs = compared(fingerprint.fingerprints(table, high=0.2, rows=5), duck_of(table), lines)
    assert ours == theirs


def test_fingerprints_of_ids_that_many_rows_share(docs, words, duck_of):
    rows = [(i, words(i, 8)) for i in range(60)] + [(None, words(300 + i % 70, 9)) for i in range(90)] + [(31, words(500 + i, 7)) for i in range(80)] + [(31, ""), (None, "é" * 9), (None, None)]
    table = docs(rows)
    lines = oracles.FINGERPRINTS.replace(f"{fingerprint.HIGH} *", "0.2 *")
    ours, theirs = compared(fingerprint.fingerprints(table, high=0.2, rows=5), duck_of(table), lines)
    assert ours == theirs
    counts = [r["count"] for r in fingerprint.ranged(table, 5).filter("_ghost = 0").groupBy("_range").count().collect()]
    assert max(counts) < 30 and sum(counts) == len(rows)


def test_fingerprints_of_odd_tables(odd, docs):
    rows = fingerprint.fingerprints(odd).collect()
    assert len(rows) == odd.count()
    assert len({r["fingerprint"] for r in rows if r["n_chars"] == len("the same words in this text again")}) == 1
    assert fingerprint.fingerprints(odd.limit(0)).isEmpty()
    (alone,) = fingerprint.fingerprints(docs([(1, "abcdef")])).collect()
    assert (alone["near_next"], alone["n_chars"]) == (1.0, 6)


# the pipeline


def test_pipeline_stages(spark, sf_dir):
    from tallyvault.llm import language, packing, pii

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 120")
    columns, frames = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], sf_dir).persist())
    known, single, clean, mix, packed = frames[1:]
    assert all(f.columns == columns for f in frames[1:5])
    assert known.count() == docs.count()  # every test document has letters of its language
    want = {d for d, (least, _) in brute([(r["doc_id"], r["text"]) for r in known.collect()]).items() if d == least}
    assert {r["doc_id"] for r in single.collect()} == want
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == {d: pii.masked(t) for d, t in texts.items()}
    assert {r["doc_id"] for r in mix.collect()} <= set(texts)
    assert packed.select("doc_id").distinct().count() == mix.select("doc_id").distinct().count()
    assert packed.filter("piece = 0").count() == mix.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter(F.col("n") > packing.CAPACITY).isEmpty()
    assert isinstance(language.UNKNOWN, str)


def test_pipeline_of_odd_and_empty_tables(spark, odd, docs, words, tmp_path):
    """Null and empty texts are in no language and go; of rows alike one stays; clashing columns are kept to the last stage but one."""
    frame = odd
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, frame, "")
        empty = stage(spark, frame.limit(0), "")
        assert empty.isEmpty(), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == odd.columns and empty.columns == odd.columns, name
            frame = after.persist()
    assert {r["doc_id"] for r in frame.select("doc_id").collect()} <= {3, 4, 7, None}
    odd.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_pipeline_rejects_what_no_label_explains(spark, docs, words):
    import random

    from tallyvault.llm import language

    dice = random.Random(8)
    known = [(i, words(i % 4, 60), "s", "aa") for i in range(40)]
    strange = [(100 + i, "".join(chr(0x4E00 + dice.randrange(3000)) for _ in range(200)), "s", None) for i in range(5)] + [(200, None), (201, "…!"), (202, "")]
    table = docs(known + strange)
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, table, "").collect()}
    model = language.fit(table)

    def explained(text):
        plain = "".join(map(chr, language.points(text or "")))
        if not any(c.isalpha() for c in plain):
            return False
        cost = [model.phrases([language.points(text)])[0, k] for k in range(len(model.langs))]
        return min(cost) * len(plain) <= model.most[cost.index(min(cost))] * len(plain) + language.FIRST_PHRASES

    assert kept == {r["doc_id"] for r in table.collect() if explained(r["text"])} and set(range(40)) <= kept
    assert not kept & set(range(100, 203))


@pytest.mark.parametrize("name", dict(corpus_pipeline.STAGES))
def test_stages_bound_what_a_worker_gets_at_once(spark, words, name):
    """Rows of 16 MB reach a Python worker in batches of 4 MB, or of what the session says."""
    import pandas as pd

    def most(session):
        def sizes(texts: pd.Series) -> pd.Series:
            return pd.Series([texts.str.len().sum()] * len(texts))

        texts = session.range(0, 4000, 1, 1).select(F.repeat(F.lit("word"), 1000).alias("text"), "id")
        return texts.select(F.pandas_udf(sizes, "long")(F.concat("text", "id")).alias("n")).agg(F.max("n")).first()[0]

    for bound, limit in ((None, 4 << 20), ("1m", 1 << 20)):
        own = spark.newSession()  # without what other tests have set
        own.conf.set("spark.sql.shuffle.partitions", "2")
        if bound:
            own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", bound)
        rows = own.createDataFrame([(i, words(i % 2, 30), "en", "s", 1) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
        dict(corpus_pipeline.STAGES)[name](own, rows, "")
        assert limit / 2 < most(own) <= limit + 5000


def test_near_texts_of_one_id(docs):
    """Rows that share an id are told apart by their texts: as quick as rows of their own ids, and the same classes."""
    import time

    def text(i):
        return " ".join(f"w{j}" if j != i % 190 else f"x{i}" for j in range(200))

    took = {}
    for ids in ("warm", "own", "one", "one"):
        table = docs([(1 if ids == "one" else i, text(i)) for i in range(1500)] + [(1, text(3))] * (300 if ids == "one" else 0)).repartition(4)
        began = time.time()
        found = near.near_duplicates(table).select("class_id", "links", "copies").distinct().collect()
        took[ids] = min(took.get(ids, 1e9), time.time() - began)
        if ids == "one":
            assert {tuple(r) for r in found} == {(1, 1799, 1), (1, 1799, 301)}
        else:
            assert {tuple(r) for r in found} == {(0, 1499, 1)}
    assert took["one"] < 2 * took["own"] + 3, took

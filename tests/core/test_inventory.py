"""Small inventories with exact expectations."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyvault import cursor, schemas, spec
from tallyvault.errors import InvalidFilter, InvalidInventory, Refused
from tallyvault.functions import paths, text
from tallyvault.inventory import Inventory, Store
from tallyvault.operators import archives, audit, browse, candidates, dag, duplicates, images, merge, scenario, search, signatures


def sha(body: str) -> str:
    return hashlib.sha256(body.encode()).hexdigest()


def built(spark, scans: dict[int, dict[str, str]], roots=None, unhashed=(), errors=(), mtimes=None) -> Inventory:
    """Scans as {scan: {path: content}}; every file is hashed unless it is named in `unhashed`."""
    rows, hashes, dirs, heads = [], [], [], []
    for s, files in scans.items():
        folders = sorted({p.rsplit("/", i)[0] for p in files for i in range(1, p.count("/") + 1)}, key=lambda p: (p.count("/"), p))
        ids = {"": 1} | {p: i for i, p in enumerate(folders, 2)}
        for p, i in ids.items():
            parent = ids[p.rpartition("/")[0]] if p else 0
            rows.append((s, i, parent, p, p.rpartition("/")[2], "DIRECTORY", 0, 0, 0))
            dirs.append((s, i, parent, p, True))
        for i, (p, body) in enumerate(files.items(), len(ids) + 1):
            t = (mtimes or {}).get((s, p), (0, 0))
            rows.append((s, i, ids[p.rpartition("/")[0]], p, p.rpartition("/")[2], "FILE", len(body.encode()), *t))
            if (s, p) not in unhashed:
                hashes.append((s, i, sha(body)))
        heads.append((s, f"scan-{s}", (roots or {}).get(s, f"/root/{s}"), "COMPLETE", "SHA-256", None, len(rows) + 10, None, None))
    made = {"scans": heads, "entries": rows, "directories": dirs, "hashes": hashes, "scan_errors": [(s, "HASHING", p, "READ_ERROR", 1000 + k) for k, (s, p) in enumerate(errors)]}
    return Inventory(spark, {t: spark.createDataFrame(r, schemas.SCHEMAS[t]) for t, r in made.items()})


def ids(inv: Inventory, scan: int, *names: str) -> list[int]:
    found = {r["relative_path"]: r["entry_id"] for r in inv.entries.filter(F.col("scan_id") == scan).collect()}
    return [found[n] for n in names]


@pytest.fixture(scope="module")
def single(spark):
    return built(spark, {1: {"alpha/a.txt": "same", "beta/b.bin": "same", "beta/not-a-duplicate": "else", "unique": "a-unique-file-length", "empty-a": "", "empty-b": ""}}, unhashed={(1, "unique")})


def test_duplicates_need_size_and_content(single):
    status = duplicates.status(single, "scan-1").first()
    assert (status["files"], status["directories"], status["hashes"], status["candidate_files"]) == (6, 3, 5, 5)
    rows = duplicates.report(single, "scan-1").collect()
    assert [(r["relative_path"], r["copies"]) for r in rows] == [("alpha/a.txt", 2), ("beta/b.bin", 2), ("empty-a", 2), ("empty-b", 2)]
    assert rows[-1]["sha256"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    with pytest.raises(Refused):
        duplicates.report(single, "nowhere")


def test_hash_modes(spark):
    bare = built(spark, {1: {"pair-a": "same", "pair-b": "same", "unique": "alone!"}}, unhashed={(1, "pair-a"), (1, "pair-b"), (1, "unique")})
    assert candidates.to_hash(bare, 1).count() == 2
    done = built(spark, {1: {"pair-a": "same", "pair-b": "same", "unique": "alone!"}}, unhashed={(1, "unique")})
    assert candidates.to_hash(done, 1).count() == 0
    assert {r["relative_path"] for r in candidates.to_hash(done, 1, rehash=True).collect()} == {"pair-a", "pair-b"}
    assert {r["relative_path"] for r in candidates.to_hash(done, 1, complete=True).collect()} == {"unique"}
    assert candidates.to_hash(done, 1, True, True).count() == 3


def test_cross_scan_gates_by_size(spark):
    inv = built(spark, {1: {"match": "same", "local-one": "local", "local-two": "local", "only-A": "a"}, 2: {"match": "same", "only-B": "bb"}, 3: {"not-selected": "local"}})
    chosen = candidates.selected(inv, ["scan-1", "scan-2"])
    assert candidates.cross_sizes(inv, chosen).count() == 1
    assert candidates.cross_candidates(inv, chosen).count() == 2
    inv = built(spark, {1: {"a": "same", "b": "same", "only-here-1": "else", "only-here-2": "else"}, 2: {"c": "same", "different": "abcd"}, 3: {"d": "same", "unmatched": "wxyz"}})
    names = ["scan-3", "scan-1", "scan-2"]
    rows = duplicates.cross_report(inv, names).collect()
    assert candidates.cross_candidates(inv, candidates.selected(inv, names)).count() == 8
    assert [r["scan_name"] for r in rows] == ["scan-3", "scan-1", "scan-1", "scan-2"] and {(r["copies"], r["scan_count"]) for r in rows} == {(4, 3)}
    assert duplicates.cross_summary(inv, names)["phase"] == "COMPLETE"


@pytest.mark.parametrize("names", [None, [], ["scan-1"], ["scan-1", "scan-1"], ["scan-1", " "], ["scan-1", "scan-9"]])
def test_cross_scan_refusals(single, names):
    with pytest.raises(Refused):
        candidates.selected(single, names)


def test_insert_if_absent_and_upsert(spark, single):
    files = single.entries.filter("kind = 'FILE'").select("scan_id", "entry_id")
    (unique,) = ids(single, 1, "unique")
    new = spark.createDataFrame([(1, unique, sha("a-unique-file-length"))], schemas.SCHEMAS["hashes"])
    assert candidates.absent(new.unionByName(single.hashes), single.hashes, files).collect()[0]["entry_id"] == unique
    with pytest.raises(Refused):
        candidates.absent(single.hashes.withColumn("sha256", F.lit("0" * 64)), single.hashes, files)
    with pytest.raises(Refused):
        candidates.absent(spark.createDataFrame([(1, 999, "0" * 64)], schemas.SCHEMAS["hashes"]), single.hashes, files)
    assert candidates.upserted(single.hashes, new).count() == 6


@pytest.fixture(scope="module")
def explorer(spark):
    return built(
        spark,
        {
            1: {"A/shared-one.txt": "same", "B/shared-two.txt": "same", "A/different-one.txt": "else", "B/different-two.txt": "else", "A/local-one.bin": "first local", "B/local-two.bin": "first local", "A/empty-one": "", "B/empty-two": "", "cross-only.bin": "x"},
            2: {"shared-three": "same", "shared-four": "same", "different-three": "else", "different-four": "else", "local-three": "second local", "local-four": "second local", "empty-three": "", "empty-four": "", "cross-only.bin": "x"},
            3: {"shared-five": "same", "shared-six": "same"},
        },
        unhashed={(1, "cross-only.bin"), (2, "cross-only.bin")}, errors=[(1, "A/shared-one.txt")],
    )


def test_groups(explorer):
    def groups(**request):
        return duplicates.groups(explorer, request).collect()

    assert [(g["occurrences"], g["scan_count"]) for g in groups(scan_ids=[1])] == [(2, 1)] * 4
    assert [g["occurrences"] for g in groups(scan_ids=[1, 2], min_scans=2)] == [4] * 3
    assert len(groups(scan_ids=[1, 2])) == 5 and not groups(scan_ids=[1, 2], min_occurrences=5) and not groups(scan_ids=[1, 2], min_scans=3)
    one = groups(scan_ids=[1, 2, 3], name={"value": "shared"})
    assert [(g["occurrences"], g["scan_count"]) for g in one] == [(6, 3)]
    request = {"scan_ids": [1, 2], "name": {"value": "shared-one.txt", "match": "EXACT"}, "path": {"under": "A"}, "extensions": ["TXT"]}
    (g,) = groups(**request)
    assert (g["occurrences"], g["matching_occurrences"]) == (4, 1)
    assert [r["matches_filters"] for r in duplicates.occurrences(explorer, g["group_id"], request).collect()].count(True) == 1
    assert groups(scan_ids=[1, 2], error_state="HAS")[0]["error_occurrences"] == 1
    cover = duplicates.coverage(explorer, [1, 2]).first()
    assert (cover["files"], cover["hashed_files"], cover["unhashed_files"], cover["errors"]) == (18, 16, 2, 1)
    assert duplicates.group_summary(explorer, {"scan_ids": [1, 2], "min_scans": 2}).first()["occurrences"] == "12"
    (anchor, bare) = ids(explorer, 1, "A/shared-one.txt", "cross-only.bin")
    assert len(groups(scan_ids=[1, 2], reference={"scan_id": 1, "entry_id": anchor})) == 1
    with pytest.raises(Refused, match="digest"):
        groups(scan_ids=[1, 2], reference={"scan_id": 1, "entry_id": bare})


def test_totals_are_exact(explorer):
    huge = explorer.with_tables(entries=explorer.entries.withColumn("size", F.when(F.col("kind") == "FILE", F.lit(2**63 - 1)).otherwise(F.lit(0)).cast("long")))
    row = duplicates.group_page(huge, {"scan_ids": [1, 2], "name": {"value": "shared"}}).first()
    assert row["observed_bytes"] == "36893488147419103228"


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("sort", spec.GROUP_SORTS)
def test_pages_of_one_equal_the_whole(explorer, sort, descending):
    request = {"scan_ids": [1, 2, 3], "sort": sort, "descending": descending}
    whole = [r["group_id"] for r in duplicates.group_page(explorer, request).collect()]
    seen, position = [], None
    key = {"SIZE": "size", "OCCURRENCES": "occurrences", "SCANS": "scan_count", "OBSERVED_BYTES": "observed_bytes"}[sort]
    for _ in whole:
        rows, more = cursor.cut(duplicates.group_page(explorer, request | {"limit": 1}, position).collect(), 1)
        seen.append(rows[0]["group_id"])
        position = [rows[0][key], rows[0]["size"], rows[0]["sha256"]]
    assert seen == whole and not more


@pytest.fixture(scope="module")
def searched(spark):
    return built(
        spark,
        {
            1: {"A/Same.TXT": "same persisted content", "B/same.txt": "same persisted content", "A/unique.log": "u", "A/picture.JPG": "jj", "A/nested/deep.md": "ddd", "unicode-λ.txt": "λλλλ"},
            2: {"copy-one.txt": "same persisted content", "copy-two.txt": "same persisted content", "unhashed.bin": "x"},
        },
        unhashed={(2, "unhashed.bin")}, errors=[(1, "A/unique.log")], mtimes={(1, "A/unique.log"): (1_700_000_000, 5)},
    )


def test_search(searched):
    def found(**request):
        return [r["relative_path"] for r in search.page(searched, request).collect()]

    exact = {"value": "same.txt", "match": "EXACT"}
    assert found(name=exact, scan_ids=[1]) == ["A/Same.TXT", "B/same.txt"]
    assert found(name=exact | {"case_sensitive": True}) == ["B/same.txt"]
    assert found(name={"value": "uni", "match": "STARTS_WITH"}) == ["A/unique.log", "unicode-λ.txt"]
    assert found(name={"value": ".JPG", "match": "ENDS_WITH"}) == ["A/picture.JPG"]
    assert len(found(name={"value": "*.txt", "match": "GLOB"})) == 5
    assert len(found(name={"value": r"^copy-(one|two)\.txt$", "match": "REGEX"})) == 2
    assert found(path={"contains": "A/"}, extensions=["LOG"]) == ["A/unique.log"]
    (a,) = ids(searched, 1, "A")
    assert len(found(directory={"scan_id": 1, "entry_id": a, "recursive": False})) == 3
    assert len(found(directory={"scan_id": 1, "entry_id": a, "recursive": True})) == 4
    rows = search.page(searched, {"duplicate_state": "ACROSS_SCANS"}).collect()
    assert [(r["copies"], r["scan_copies"]) for r in rows] == [(4, 2)] * 4
    assert len(found(duplicate_state="COPIES_3")) == 4 and "A/unique.log" in found(duplicate_state="NOT_CONFIRMED")
    assert found(error_state="HAS") == ["A/unique.log"] and not found(name={"value": "x' OR 1=1 --", "match": "EXACT"})
    assert found(modified={"exact": 1_700_000_000}) == ["A/unique.log"]


def test_search_pages_with_cursors(searched):
    request, seen = {"sort": "SIZE", "descending": True, "limit": 2}, []
    while True:
        out = search.search(searched, request)
        seen += [r["relative_path"] for r in out["items"]]
        if not out["next_cursor"]:
            break
        request = request | {"cursor": out["next_cursor"]}
    assert seen == [r["relative_path"] for r in search.page(searched, {"sort": "SIZE", "descending": True}).collect()]
    assert out["coverage"]["has_unhashed_files"]
    with pytest.raises(InvalidFilter):
        search.search(searched, request | {"sort": "PATH", "cursor": request["cursor"]})


def test_saves_at_once(spark, searched, tmp_path, monkeypatch):
    """Appends survive each other, what others touch meanwhile is refused, and no number is given twice."""
    store, other = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    store.save(**{t: getattr(searched, t) for t in schemas.BASE})

    def digests(scan_id, *entries):
        return spark.createDataFrame([(scan_id, e, "0" * 64) for e in entries], schemas.SCHEMAS["hashes"])

    def meanwhile(change):
        """Let another writer save after this one has read and written, before it gets its number."""
        create, done = Store._create, []

        def first(self, revision, text):
            if self is store and not done:
                done.append(True)
                change()
            return create(self, revision, text)

        monkeypatch.setattr(Store, "_create", first)

    before = store.load().hashes.count()
    meanwhile(lambda: other.save(append=True, hashes=digests(8, 1, 2)))
    assert store.save(append=True, hashes=digests(8, 3)) == 3
    assert store.load().hashes.count() == before + 3
    # one that has read first does not add what it may have missed
    base = store.load().revision
    meanwhile(lambda: other.save(append=True, hashes=digests(8, 4)))
    with pytest.raises(Refused, match="changed"):
        store.save(append=True, base=base, hashes=digests(8, 4))
    assert store.load().hashes.filter("entry_id = 4 and scan_id = 8").count() == 1
    # other scans do not matter, the same one does, in whatever way
    base = store.load().revision
    meanwhile(lambda: other.save(scan=7, hashes=digests(7, 1)))
    store.save(scan=8, base=base, hashes=digests(8, 9))
    assert [r[0] for r in store.load().hashes.filter("scan_id in (7, 8)").orderBy("scan_id").select("entry_id").collect()] == [1, 9]
    for change in (lambda: other.save(scan=8, hashes=digests(8, 5)), lambda: other.save(append=True, hashes=digests(8, 6)), lambda: other.compact("hashes")):
        meanwhile(change)
        with pytest.raises(Refused, match="changed"):
            store.save(scan=8, hashes=digests(8, 7))
    meanwhile(lambda: other.save(append=True, hashes=digests(8, 10)))
    with pytest.raises(Refused, match="changed"):
        store.compact()
    # two scans that took the same new id
    head = [(9, n, "/r", "READY", "SHA-256", None, 2, None, None) for n in ("x", "y")]
    meanwhile(lambda: other.save(append=True, scans=spark.createDataFrame(head[:1], schemas.SCHEMAS["scans"])))
    with pytest.raises(Refused, match="scan 9"):
        store.save(append=True, scans=spark.createDataFrame(head[1:], schemas.SCHEMAS["scans"]))
    revision = store.revision()
    meanwhile(lambda: other.save(scan=1, hashes=digests(1, 1)))
    with pytest.raises(Refused, match="changed"):
        store.save(revision=revision, signatures=searched.signatures)
    assert store.revision() == revision + 1 and other.manifest(revision)["revision"] == revision


def test_saves_from_threads(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    folder = str(tmp_path / "s")

    def add(i):
        return Store(spark, folder).save(append=True, hashes=spark.createDataFrame([(1, i, "0" * 64)], schemas.SCHEMAS["hashes"]))

    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(add, range(18)))
    assert sorted(numbers) == list(range(1, 19))
    assert {r["entry_id"] for r in Store(spark, folder).load().hashes.collect()} == set(range(18))


@pytest.mark.parametrize(
    "request_",
    [{"limit": 0}, {"limit": 501}, {"kinds": []}, {"sort": "X"}, {"size": {"exact": 1, "min": 0}}, {"size": {"min": -1}}, {"extensions": ["a/b"]}, {"name": {"value": "(?=x)", "match": "REGEX"}}, {"name": {"value": "", "match": "EXACT"}}, {"name": {"value": "(", "match": "REGEX"}}],
)
def test_bad_requests(searched, request_):
    with pytest.raises(InvalidFilter):
        search.page(searched, request_).collect()


def test_patterns_mean_the_same_in_both_engines(spark, duck):
    names = ["a.txt", "a.txt\n", "A\nb", "Λ.TXT", "a\rb", "x.y", "[z]", "a+b?"]
    df = spark.createDataFrame([(n,) for n in names], "filename string")
    for pattern, how in [(r"a.b", "REGEX"), (r"txt$", "REGEX"), (r"^λ", "REGEX"), ("a+b?", "GLOB"), ("[z]", "GLOB"), ("*.txt", "GLOB")]:
        ours = {r[0] for r in df.filter(text.named(F.col("filename"), pattern, how, False)).collect()}
        regex = text.glob(pattern) if how == "GLOB" else pattern
        theirs = {n for n in names if duck.execute("SELECT regexp_matches(?, ?, 'i')", [n, regex]).fetchall()[0][0]}
        assert ours == theirs, pattern


def test_browse(spark):
    inv = built(spark, {1: {"A/same.txt": "s", "B/same.txt": "s", "A/unique.txt": "uu", "A/new\nline": "n"}, 2: {"x": "s"}}, unhashed={(2, "x"), (1, "A/new\nline"), (1, "A/unique.txt")}, errors=[(1, "first"), (1, "second"), (1, "third")])
    top = browse.dashboard(inv).first()
    assert (top["scans"], top["duplicate_groups"], top["hashes"]) == (2, 1, 2)
    first = browse.children(inv, 1, 1, 1).orderBy("filename").collect()
    assert [r["filename"] for r in first] == ["A", "B"]
    later = browse.children(inv, 1, 1, 1, [0, "A", first[0]["entry_id"]]).collect()
    assert [r["filename"] for r in later] == ["B"]
    assert [r["relative_path"] for r in browse.errors(inv, 1).collect()] == ["third", "second", "first"]
    assert [r["relative_path"] for r in browse.errors(inv, 1, 2, 2).collect()] == ["first"]
    (deep,) = ids(inv, 1, "A/same.txt")
    assert [r["relative_path"] for r in browse.breadcrumbs(inv, 1, deep).collect()] == ["", "A", "A/same.txt"]
    assert browse.entry(inv, 1, deep).first()["copies"] == 2
    assert {r["scan_id"]: r["files"] for r in browse.summaries(inv).collect()} == {1: 4, 2: 1}


@pytest.fixture(scope="module")
def planned(spark):
    a = {"keep/a.txt": "same", "remove/b.txt": "same", "remove/c.txt": "same", "empty-a": "", "empty-b": "", "unresolved": "other!"}
    return built(spark, {1: a, 2: {"x.txt": "same", "y.txt": "same", "unresolved": "other!"}, 3: a}, roots={1: "/r/a", 2: "C:/B", 3: "/r/a"}, unhashed={(1, "unresolved"), (2, "unresolved"), (3, "unresolved")})


def test_plan_keeps_one_of_each_group(planned):
    config = {"request": {"scan_ids": [1, 2]}, "rules": [{"kind": "PREFER_PATH", "path": "keep"}]}
    made = scenario.decisions(planned, config)
    by = {(r["scan_id"], r["relative_path"]): (r["decision"], r["reason"]) for r in made.collect()}
    assert by[1, "keep/a.txt"] == ("KEEP", "RULE_KEEPER") and by[2, "x.txt"] == ("REMOVE", "RULE_REDUNDANT")
    assert [d for d, _ in by.values()].count("KEEP") == 2
    out = scenario.generate(planned, config)
    assert out["validation"] == {"valid": True, "errors": {}, "warnings": {}} and out["summary"]["groups"] == 2
    assert out["source_fingerprint"] == scenario.fingerprint(planned, config)


def test_plan_protects_and_aliases(planned):
    config = {"request": {"scan_ids": [1, 2, 3]}, "protections": [{"path": "remove"}], "rules": [{"kind": "PREFER_SCAN", "scan_id": 2}]}
    by = {(r["scan_id"], r["relative_path"]): r["reason"] for r in scenario.decisions(planned, config).collect()}
    assert by[1, "remove/b.txt"] == by[3, "remove/b.txt"] == "PROTECTED"
    # scans 1 and 3 record the same paths: one keeper for both
    assert {by[1, "empty-a"], by[3, "empty-a"]} == {"RULE_KEEPER"} and by[1, "empty-b"] == "RULE_REDUNDANT"
    # what is protected is kept anyway, so it is the keeper
    assert by[2, "x.txt"] == "RULE_REDUNDANT"


def test_plan_overrides_and_validation(spark, planned):
    config = {"request": {"scan_ids": [1, 2]}}
    made = scenario.decisions(planned, config)
    group = made.filter("relative_path = 'x.txt'").first()["group_id"]
    keys = [r["path_key"] for r in made.filter(F.col("group_id") == group).collect()]
    every = spark.createDataFrame([(k, group, "REMOVE") for k in keys] + [("gone", "1:0", "KEEP")], "path_key string, group_id string, decision string")
    again = scenario.decisions(planned, config, every)
    assert scenario.validation(again, every)["errors"] == {"NO_RETAINED_CANDIDATE": 1, "STALE_OVERRIDES": 1}
    manual = scenario.decisions(planned, config | {"manual": True})
    assert scenario.validation(manual)["errors"].keys() == {"UNDECIDED_DECISIONS"}
    with pytest.raises(Refused):
        scenario.generate(planned.with_tables(scans=planned.scans.withColumn("phase", F.lit("HASHING"))), config)
    with pytest.raises(Refused):
        scenario.generate(planned, config | {"max_occurrences": 1})


def test_plans_that_take_too_long_are_cancelled(spark):
    import time

    from tallyvault.operators import scenario

    began = time.time()
    with pytest.raises(Refused, match="too long"), scenario.deadline(spark, 1):
        spark.range(10**13).selectExpr("sum(hash(id, id + 1) % 7)").collect()
    assert time.time() - began < 30
    with scenario.deadline(spark, 60):
        assert spark.range(10).count() == 10
    with pytest.raises(ZeroDivisionError), scenario.deadline(spark, 60):
        1 / 0


def test_one_content_that_most_files_have(spark, monkeypatch):
    """No task of a report, a comparison, a search or a plan gets the rows of a hot content, by the rows that leave each task."""
    from tallyvault.operators import hot, scenario

    n, tasks = 60_000, 40
    name = F.concat(F.lit("f"), F.col("entry_id").cast("string"))
    common = F.col("entry_id") % 10 != 0
    ids_ = spark.range(1, n + 1).select(F.explode(F.array(*[F.lit(s).cast("long") for s in (1, 2)])).alias("scan_id"), F.col("id").alias("entry_id"))
    entries = ids_.select("scan_id", "entry_id", F.lit(0).cast("long").alias("parent_id"), name.alias("relative_path"), name.alias("filename"), F.lit("FILE").alias("kind"), F.when(common, 5).otherwise(F.col("entry_id")).cast("long").alias("size"), F.col("entry_id").alias("modified_sec"), F.lit(0).alias("modified_nano"))
    digests = ids_.select("scan_id", "entry_id", F.when(common, F.lit("a" * 64)).otherwise(F.sha2(F.col("entry_id").cast("string"), 256)).alias("sha256"))
    heads = [(s, f"scan-{s}", f"/r{s}", "COMPLETE", "SHA-256", None, n + 1, None, None) for s in (1, 2)]
    inv = Inventory(spark, {t: spark.createDataFrame([], schemas.SCHEMAS[t]) for t in schemas.BASE}).with_tables(
        scans=spark.createDataFrame(heads, schemas.SCHEMAS["scans"]), entries=entries.persist(), hashes=digests.persist()
    )
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    monkeypatch.setattr(hot, "HOT", 3)
    try:
        for k, v in zip(before, (str(tasks), "false", "-1"), strict=True):
            spark.conf.set(k, v)
        files = duplicates.hashed_files(inv)
        counted = duplicates.with_counts(files, [F.count("*").alias("copies")], F.col("copies") > 1)
        plan = scenario.decisions(inv, {"request": {"scan_ids": [1, 2]}, "rules": [{"kind": "NEWEST"}]})
        gated = candidates.cross_candidates(inv, candidates.selected(inv, ["scan-1", "scan-2"]))
        found = search.matching(inv, {"scan_ids": [1, 2]})
        for what, df in (("report", counted), ("plan", plan), ("sizes", gated), ("search", found), ("to hash", candidates.to_hash(inv, 1, rehash=True))):
            shares = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]
            assert sum(shares) == (n if what == "to hash" else 2 * n), what
            assert max(shares) < 3 * sum(shares) / tasks, (what, max(shares))
        assert {r["copies"]: r["count"] for r in counted.groupBy("copies").count().collect()} == {2: n // 10 * 2, n // 10 * 18: n // 10 * 18}
        kept = {r[0] for r in plan.filter("decision = 'KEEP' and size = 5").select("entry_id").collect()}
        assert kept == {n - 1}  # the newest of the common content, by name the first
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_conflicting_history_is_unresolved(spark):
    inv = built(spark, {1: {"p": "one!", "q": "same"}, 2: {"p": "same", "r": "same"}}, roots={1: "/x", 2: "/x"})
    by = {(r["scan_id"], r["relative_path"]): r["reason"] for r in scenario.decisions(inv, {"request": {"scan_ids": [1, 2]}}).collect()}
    assert by[2, "p"] == "CONFLICTING_HISTORY"


def test_signatures_and_searches(searched):
    (same, bare) = ids(searched, 1, "A/Same.TXT")[0], ids(searched, 2, "unhashed.bin")[0]
    table = signatures.created(searched, 1, same, "mine")
    inv = searched.with_tables(signatures=table)
    key = table.first()["id"]
    assert signatures.matches(inv, key).count() == 4
    page = signatures.decorated(search.page(inv, {}), table)
    assert page.filter("signature_tag = 'mine'").count() == 4 and page.count() == 9
    with pytest.raises(Refused, match="signature"):
        signatures.created(inv, 1, same, "again")
    with pytest.raises(Refused, match="digest"):
        signatures.created(inv, 2, bare, "no")
    saved = signatures.saved_search(searched, "/db", "mine", {"sort": "SIZE"})
    kept = searched.with_tables(saved_searches=saved)
    assert signatures.saved_searches(kept, "/db").count() == 1
    with pytest.raises(Refused):
        signatures.saved_search(kept, "/db", "mine", {})
    assert signatures.without(saved, saved.first()["id"]).isEmpty()


def test_signatures_and_searches_are_updated(searched):
    inv = searched
    file = inv.hashes.first()
    made = inv.with_tables(signatures=signatures.created(inv, file["scan_id"], file["entry_id"], "tag", "memo"))
    id_ = made.signatures.first()["id"]
    after = made.with_tables(signatures=signatures.updated(made, id_, tag="other"))
    row = signatures.get(after.signatures, id_)
    assert (row["tag"], row["memo"], row["sha256"]) == ("other", "memo", file["sha256"]) and row["updated_at"] >= row["created_at"]
    assert signatures.listed(after).first()["files"] >= 1
    for bad in ({"tag": " "}, {"tag": "x" * 121}, {"memo": "x" * 4001}):
        with pytest.raises(InvalidFilter):
            signatures.updated(after, id_, **bad)
    with pytest.raises(Refused):
        signatures.updated(after, "none", tag="x")
    for name in ("one", "two"):
        inv = inv.with_tables(saved_searches=signatures.saved_search(inv, "p", name, {}))
    ids = {r["name"]: r["id"] for r in inv.saved_searches.collect()}
    with pytest.raises(Refused, match="name"):
        signatures.updated_search(inv, ids["one"], name="two")
    changed = signatures.updated_search(inv, ids["one"], name="three", request={"extensions": ["txt"]})
    assert {r["name"] for r in changed.collect()} == {"two", "three"} and "txt" in changed.filter("name = 'three'").first()["request_json"]


def test_sound_inventories_pass_their_audit(searched, planned):
    for inv in (searched, planned):
        assert audit.counted(audit.rules(inv)).filter("failures > 0").collect() == []
    with pytest.raises(InvalidInventory):
        audit.require(searched.with_tables(hashes=searched.hashes.unionByName(searched.hashes)))


def test_merge(spark, searched, planned, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.save(**{t: getattr(planned, t) for t in schemas.BASE})
    source = searched.with_tables(scans=searched.scans.withColumn("name", F.concat(F.lit("new-"), "name")))
    ready = merge.merge(source, store, dry_run=True)
    assert (ready["status"], ready["new_scan_id_first"], ready["new_scan_id_last"]) == ("READY", 4, 5)
    done = merge.merge(source, store)
    merged = store.load()
    assert done["status"] == "IMPORTED" and merged.scans.count() == 5
    assert merged.entries.count() == searched.entries.count() + planned.entries.count()
    assert merged.hashes.filter("scan_id >= 4").count() == searched.hashes.count()
    with pytest.raises(Refused, match="both"):
        merge.merge(source, store)
    with pytest.raises(Refused, match="changed"):
        store.save(revision=0, scans=merged.scans)


def test_new_ids_are_never_the_old_ones(spark):
    source = built(spark, {5: {"a": "a"}, 7: {"b": "b"}, 9: {"c": "c"}})
    destination = built(spark, {4: {"z": "z"}})
    assert [(r[0], r[1]) for r in merge.scan_map(source, destination).collect()] == [(5, 6), (7, 8), (9, 10)]
    other = [s.with_tables(archive_results=spark.createDataFrame([(f"{i:08d}-0000-0000-0000-{i:012d}", 5)], "result_id string, scan_id long"), archive_runs=spark.createDataFrame([(5, "COMPLETE")], schemas.SCHEMAS["archive_runs"])) for i, s in ((1, source), (2, destination))]
    (row,) = merge.result_map(*other, "archive", "s").collect()
    assert row[0] != row[1] and len(row[1]) == 36


def test_generations(spark, searched, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.save(**{t: getattr(searched, t) for t in schemas.BASE}) == 1
    assert store.load().entries.count() == searched.entries.count()
    store.save(hashes=searched.hashes.limit(1))
    assert store.load().hashes.count() == 1 and store.load().entries.count() == searched.entries.count()
    with pytest.raises(schemas.UnsupportedSchema):
        store.save(hashes=searched.hashes.withColumn("more", F.lit(1)))


@pytest.mark.parametrize(
    "root, style",
    [("/a/b", "POSIX"), ("/", "POSIX"), ("C:/x", "WINDOWS_DRIVE"), ("c:/", "WINDOWS_DRIVE"), ("//srv/share", "WINDOWS_UNC"), ("//srv", "UNKNOWN"), ("a/b", "UNKNOWN"), ("/a//b", "UNKNOWN"), ("/a/../b", "UNKNOWN"), ("C:/aux.txt", "UNKNOWN"), ("C:/a. ", "UNKNOWN"), ("C:/a?b", "UNKNOWN"), ("/a?b", "POSIX"), ("", "UNKNOWN"), (None, "UNKNOWN"), ("C:/com¹.x", "UNKNOWN"), ("C:/communal", "WINDOWS_DRIVE")],
)
def test_path_styles(spark, root, style):
    df = spark.createDataFrame([(root,)], "root string")
    assert df.select(F.coalesce(paths.style(F.col("root")), F.lit("UNKNOWN"))).first()[0] == style


def test_windows_paths():
    assert paths.encoded_windows("c:\\Users\\x\\") == "C:/Users/x"
    assert paths.encoded_windows("\\\\?\\UNC\\srv\\share\\d") == "//srv/share/d"
    assert paths.encoded_windows("\\\\?\\c:\\d") == "C:/d"
    for bad in ("\\\\.\\disk", "x\\y", "\\\\?\\Volume{1}"):
        with pytest.raises(ValueError):
            paths.encoded_windows(bad)


@pytest.mark.parametrize(
    "path, flavor, stem, slot",
    [
        ("d/a.part02.rar", "rar-parts", "d/a", 2), ("a.7z.001", "7z-split", "a.7z", 1), ("a.ZIP.3", "zip-chunks", "a.ZIP", 3), ("a.r00", "rar-old", "a", 1), ("a.z01", "zip-split", "a", 1), ("a.rar", "rar-old", "a", 0),
        ("x/a.zip", "zip-split", "x/a", 0), ("x/a.tar.gz", "single", "x/a.tar.gz", 0), ("a.part99999999999.rar", "rar-parts", "a", 2**31 - 1), ("a.txt", None, None, None),
    ],
)
def test_archive_names(spark, path, flavor, stem, slot):
    c = spark.createDataFrame([(path,)], "p string").select(archives.classified(F.col("p")).alias("c")).first()["c"]
    assert (c and tuple(c)) == (flavor and (f"{flavor}:{stem}", flavor, slot))


def test_archive_sets(spark):
    def facts(flavor, *slots):
        rows = [(1, "k", flavor, s, i) for i, s in enumerate(slots)]
        r = archives.arranged(spark.createDataFrame(rows, "scan_id long, group_key string, flavor string, slot int, source_id long")).first()
        return r["missing"], r["ambiguous"], r["reader_flavor"]

    assert facts("rar-parts", 1, 2, 3) == (False, False, "rar-parts") and facts("rar-parts", 1, 3)[0] and facts("rar-parts", 1, 1)[:2] == (True, True)
    assert facts("rar-old", 0, 1) == (False, False, "rar-old") and facts("rar-old", 0)[2] == "single"
    assert facts("zip-split", 0) == (False, False, "single") and not facts("zip-split", 1, 2, 0)[0] and facts("zip-split", 1, 2)[0] and facts("zip-split", 0, 2)[0]
    assert archives.set_fingerprint([(0, 4, sha("same"))], "zip-split") == "file-sha256:" + sha("same")


def test_archive_outcomes(spark):
    results = spark.createDataFrame([("a", True, True), ("b", True, True), ("c", False, True)], "result_id string, ended boolean, whole boolean")
    errors = spark.createDataFrame([("b", "OPERATIONAL")], "result_id string, category string")
    children = spark.createDataFrame([("a", True, 2), ("a", False, 0)], "result_id string, child_reusable boolean, child_height int")
    got = {r["result_id"]: tuple(r)[1:] for r in archives.outcome(errors, results, children).collect()}
    assert got == {"a": ("COMPLETE", False, False, 3), "b": ("PARTIAL", True, False, 0), "c": ("COMPLETE", False, False, 0)}


def test_shared_graphs(spark):
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("x", "y")], "parent string, child string")
    roots = spark.createDataFrame([("r",), (None,)], "node string")
    assert {r[0] for r in dag.reachable(roots, edges).collect()} == set("rabcd")
    nodes = spark.createDataFrame([(n,) for n in "rabcd"], "node string")
    assert dict(dag.heights(nodes, edges.filter("parent <> 'x'")).collect()) == {"d": 0, "c": 1, "a": 2, "b": 2, "r": 3}
    with pytest.raises(InvalidInventory):
        dag.heights(spark.createDataFrame([("p",), ("q",)], "node string"), spark.createDataFrame([("p", "q"), ("q", "p")], "parent string, child string"))


def test_image_parts(spark):
    assert images.resolved("top", {"top": ["base", "extent"], "base": ["deep"]}) == [(0, -1, "top"), (1, 0, "base"), (2, 1, "deep"), (3, 0, "extent")]
    with pytest.raises(InvalidInventory):
        images.resolved("a", {"a": ["b"], "b": ["a"]})
    parts = [{"ordinal": 0, "parent_ordinal": -1, "role": "PRIMARY", "format": "raw", "size": 4, "sha256": sha("same")}]
    assert images.set_fingerprint(parts, True) != images.set_fingerprint(parts, False)
    table = spark.createDataFrame([(1, c["ordinal"], c["parent_ordinal"], c["role"], c["format"], c["size"], c["sha256"]) for c in parts], "image long, ordinal long, parent_ordinal long, role string, format string, size long, sha256 string")
    for contents in (True, False):
        assert images.fingerprints(table, "image", contents).first()["fingerprint"] == images.set_fingerprint(parts, contents)


def test_sizes():
    assert spec.parsed_size("1.5 GiB") == 1_610_612_736 and spec.parsed_size("2kb") == 2000 and spec.parsed_size("7") == 7
    assert spec.shown_size(1536) == "1.5 KiB" and spec.shown_size(999, binary=False) == "999 B"
    for bad in ("x", "-1", "1 XB", "9 EiB"):
        with pytest.raises(InvalidFilter):
            spec.parsed_size(bad)
    assert spec.as_groups({"scan_ids": [1], "duplicate_state": "COPIES_3"})["min_occurrences"] == 3
    with pytest.raises(InvalidFilter):
        spec.as_groups({"scan_ids": [1], "hash_state": "UNHASHED"})


def test_plans_are_saved_state(spark, planned, tmp_path):
    from tallyvault.operators.scenario_state import Scenarios

    plans = Scenarios(Store(spark, str(tmp_path / "plans")), planned)
    plan = plans.create("mine", {"request": {"scan_ids": [1, 2]}})
    plan = plans.generate(plan["id"], 1)
    assert (plan["status"], plan["revision"]) == ("READY", 2) and plans.validate(plan["id"])["valid"]
    with pytest.raises(Refused, match="meanwhile"):
        plans.update(plan["id"], 1, name="late")
    row = plans.decisions(plan["id"]).filter("relative_path = 'x.txt'").first()
    kept = {"path_key": row["path_key"], "group_id": row["group_id"], "decision": "KEEP"}
    plan = plans.override(plan["id"], 2, [kept])
    assert plan["status"] == "DRAFT" and plans.decision_page(plan["id"], row["group_id"]).filter("pending = 'KEEP'").count() == 1
    plan = plans.generate(plan["id"], 3)
    assert plans.decisions(plan["id"]).filter("reason = 'MANUAL'").count() == 1 and plans.group_page(plan["id"]).count() == 2
    plan = plans.reset(plan["id"], 4)
    changed = Scenarios(plans.store, planned.with_tables(entries=planned.entries.withColumn("modified_sec", F.lit(9).cast("long"))))
    assert changed.validate(plan["id"])["source_changed"] and plans.listed().count() == 1
    plans.delete(plan["id"], 5)
    assert plans.listed().count() == 0

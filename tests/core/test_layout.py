"""Searches over files sorted by path, against the same searches over whole scans."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyvault import cursor, layout, schemas, spec
from tallyvault.inventory import Store
from tallyvault.operators import contents, search
from tests.core.test_inventory import built, ids, sha


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    dice = random.Random(5)
    words = ["Alpha", "beta", "GAMMA", "σίγμας", "kiosk", "report", "x"]
    paths = sorted({f"{dice.choice(words)}/{dice.choice(words)}/{dice.choice(words)}-{n}.{dice.choice(['txt', 'LOG', 'md'])}" for n in range(120)}, key=lambda p: sha(p))
    inv = built(spark, {s: {p: f"{n % 40}" for n, p in enumerate(paths) if n % 3 != s} for s in (1, 2)}, unhashed={(1, paths[2])}, errors=[(2, paths[3])])
    inv.tables["hashes"] = inv.hashes.unionByName(spark.createDataFrame([(1, 999_999, sha("lost"))], schemas.SCHEMAS["hashes"]))  # of no entry
    store = Store(spark, str(tmp_path_factory.mktemp("layout") / "s"))
    store.save(**{t: getattr(inv, t) for t in schemas.BASE})
    layout.clustered(store, [1, 2], file_rows=10)
    contents.refreshed(store)
    return store, inv


def test_rows_stay_and_zones_tell_of_them(made):
    store, inv = made
    now = store.load()
    for t in ("entries", "hashes"):
        assert sorted(map(tuple, getattr(now, t).collect())) == sorted(map(tuple, getattr(inv, t).collect()))
    zones = store.stored("zones").filter("of = 'entries'").orderBy("scan_id", "least_key").collect()
    assert len(zones) > 12 and sum(z["rows"] for z in zones) == inv.entries.count()
    for a, b in itertools.pairwise(zones):
        assert a["scan_id"] != b["scan_id"] or a["most_key"] <= b["least_key"]
    # only the digest of no entry leaves a file without bounds
    assert store.stored("zones").filter("least is null").count() == 1


REQUESTS = [
    # request, and at most how many files of entries it may open
    ({"scan_ids": [1], "limit": 3}, 4),
    ({"scan_ids": [1], "limit": 3, "descending": True}, 4),
    ({"limit": 30}, None),
    ({"scan_ids": [2], "sort": "SIZE", "limit": 7}, None),
    ({"scan_ids": [1], "path": {"under": "beta/x"}}, 3),
    ({"scan_ids": [2], "path": {"starts_with": "GAMMA/σ"}, "sort": "NAME"}, 4),
    ({"name": {"value": "KIOSK-1", "match": "STARTS_WITH"}}, 12),
    ({"name": {"value": "σίγμας", "match": "CONTAINS"}, "limit": 5}, None),
    ({"name": {"value": "kiosk-*.md", "match": "GLOB"}}, None),
    ({"name": {"value": r"^report-\d+\.LOG$", "match": "REGEX", "case_sensitive": True}}, None),
    ({"name": {"value": r"repo.t-1+", "match": "REGEX"}}, None),
    ({"name": {"value": "nowhere-to-be-found"}}, 0),
    ({"path": {"contains": "pha/ga"}}, None),  # others have it in another case
    ({"path": {"contains": "GAMMA/kiosk/r"}, "hash_state": "HASHED"}, 6),
    ({"extensions": ["log"], "error_state": "NONE", "limit": 500}, None),
    ({"duplicate_state": "ACROSS_SCANS"}, None),
]


@pytest.mark.parametrize("request_, most", REQUESTS)
def test_the_same_rows_from_fewer_files(made, request_, most):
    store, inv = made
    page, opened = layout.searched(store, request_)
    assert page.collect() == search.page(inv, request_).collect()
    assert most is None or opened <= most


def test_a_directory_reads_its_own_files(made):
    store, inv = made
    for path, recursive in (("beta", True), ("GAMMA/kiosk", False), ("", False)):
        (entry,) = ids(inv, 1, path)
        request = {"directory": {"scan_id": 1, "entry_id": entry, "recursive": recursive}, "kinds": ["FILE", "DIRECTORY"]}
        page, opened = layout.searched(store, request)
        assert page.collect() == search.page(inv, request).collect()
        assert not path or opened <= 6


def test_pages_follow_each_other(made):
    store, inv = made
    request, seen, total = {"scan_ids": [1, 2], "limit": 25}, [], store.stored("zones").filter("of = 'entries'").count()
    for falling in (False, True):
        wanted, position, seen = request | {"descending": falling}, None, []
        while True:
            page, opened = layout.searched(store, wanted, position)
            rows, more = cursor.cut(page.collect(), 25)
            seen += [(r["scan_id"], r["entry_id"]) for r in rows]
            assert opened <= total
            if not more:
                break
            position = [rows[-1]["sort_key"], rows[-1]["scan_id"], rows[-1]["entry_id"]]
        assert opened <= total / 2  # the last page lies at the end
        assert seen == [(r["scan_id"], r["entry_id"]) for r in search.page(inv, request | {"descending": falling, "limit": 500}).collect()]


def test_what_comes_later_is_found(spark, made, tmp_path):
    _, inv = made
    store = Store(spark, str(tmp_path / "s"))
    store.save(**{t: getattr(inv, t) for t in schemas.BASE})
    layout.clustered(store, [1, 2], file_rows=20)
    request = {"path": {"starts_with": "beta/new"}}
    assert layout.page(store, request).count() == 0
    store.save(append=True, entries=spark.createDataFrame([(1, 5000, 1, "beta/new.txt", "new.txt", "FILE", 4, 0, 0)], schemas.SCHEMAS["entries"]))
    store.save(append=True, hashes=spark.createDataFrame([(1, 5000, sha("late"))], schemas.SCHEMAS["hashes"]))
    (row,) = layout.page(store, request).collect()
    assert (row["entry_id"], row["sha256"], row["copies"]) == (5000, sha("late"), 1)
    # one scan is replaced: its zones are of files that do not count
    store.save(scan=1, entries=inv.entries.filter("scan_id = 1 and relative_path like 'beta/%'"))
    plain = {"scan_ids": [1, 2], "limit": 500}
    assert layout.page(store, plain).collect() == search.page(store.load(), plain).collect()
    store.compact()
    assert layout.page(store, plain).collect() == search.page(store.load(), plain).collect()
    layout.clustered(store, [1], file_rows=5)
    assert layout.page(store, plain).collect() == search.page(store.load(), plain).collect()


def test_texts_that_every_match_has():
    def grams(**request):
        return len(layout.wanted_grams(spec.file_search(request)))

    for pattern, runs in {r"^ab+c\.d$": ["ab", "c.d"], "abc?d": ["ab", "d"], r"a\d+b": ["a", "b"], "a|b": [], r"\x41bc": [], "(abc)": [], "abc*?d": ["ab", "d"], r"\.?ab": ["ab"]}.items():
        assert [r for r in layout._runs(pattern) if r] == runs, pattern
    assert grams(name={"value": "abcd"}) == 2 and grams(name={"value": "aλcd"}) == 0
    # without case, a long s or a Kelvin sign may stand for s and k
    assert grams(name={"value": "*ask.md", "match": "GLOB"}) == 1 and grams(name={"value": "*ask.md", "match": "GLOB", "case_sensitive": True}) == 4
    assert grams(extensions=["txt"]) == 2 and grams(extensions=["txt", "log"]) == 0


def test_letters_that_fold_to_ascii_are_not_lost(spark, tmp_path):
    names = ["KIOSK.txt", "kioſK.txt", "İoſk.txt", "ΑΣ.txt", "ΑΣΒ.txt", "\U0001f600abc\U0001f600", "ab"]
    inv = built(spark, {1: {n: str(i) for i, n in enumerate(names)}})
    store = Store(spark, str(tmp_path / "s"))
    store.save(**{t: getattr(inv, t) for t in schemas.BASE})
    layout.clustered(store, [1], file_rows=1)
    for value, match in (("kiosk*", "GLOB"), ("kio", "CONTAINS"), ("iosk", "REGEX"), ("ΑΣ", "STARTS_WITH"), ("abc", "CONTAINS"), ("ab", "EXACT")):
        request = {"name": {"value": value, "match": match}}
        assert layout.page(store, request).collect() == search.page(inv, request).collect(), value

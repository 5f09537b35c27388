"""Counts that a store keeps, against a count of all files."""

import pytest
from pyspark.sql import functions as F

from tallyvault import schemas
from tallyvault.errors import Refused
from tallyvault.inventory import Store
from tallyvault.operators import browse, contents, duplicates
from tallyvault.streaming import ingest
from tests.core.test_inventory import built, sha


def recount(store):
    inv = store.load()
    return sorted(map(tuple, contents.of_scans(inv, []).collect()))


def kept(store):
    return sorted((r["scan_id"], r["size"], r["sha256"], r["files"]) for r in store.stored("contents").groupBy(*contents.KEY).agg(F.sum("files").alias("files")).collect())


@pytest.fixture
def made(spark, tmp_path):
    bodies = ["same", "same", "else", "eels", "alone!", "", ""]
    inv = built(spark, {s: {f"d/{i}": b for i, b in enumerate(bodies)} for s in (1, 2, 3)})
    store = Store(spark, str(tmp_path / "s"))
    store.save(**{t: getattr(inv, t) for t in schemas.BASE if t != "hashes"}, hashes=inv.hashes.filter("scan_id = 3"))
    return store, inv


def test_each_batch_adds_its_own_counts(spark, made, tmp_path):
    store, inv = made
    arriving = [[(r["scan_id"], r["entry_id"], r["sha256"]) for r in inv.hashes.filter(f"scan_id in (1, 2) and entry_id % 3 = {k}").collect()] for k in range(3)]
    for n, rows in enumerate([*arriving, arriving[0]]):  # the last comes again
        spark.createDataFrame(rows, schemas.SCHEMAS["hashes"]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.hashes(spark, str(tmp_path / "in"), store.folder, str(tmp_path / "ck")).awaitTermination()
        assert kept(store) == [r for r in recount(store) if r[0] != 3]
        live = store.manifest()["tables"]["contents"]
        assert max(len(g) for g in live.values()) <= n + 1 and set(live) == {"1", "2"}
        # a generation has no more than its batch
        newest = [(s, g[-1], "") for s, g in live.items()]
        assert sum(r["files"] for r in store.files("contents", newest).collect()) <= 2 * len(rows)
    assert contents.missing(store) == [3]
    contents.refreshed(store)
    assert contents.missing(store) == [] and kept(store) == recount(store)
    before = kept(store)
    contents.refreshed(store, 1, 2)  # summed, not counted
    assert kept(store) == before and {len(g) for g in store.manifest()["tables"]["contents"].values()} == {1}


def test_reports_are_the_same_with_kept_counts(spark, made):
    store, inv = made
    store.save(scan=1, hashes=inv.hashes)
    store.save(scan=2, hashes=inv.hashes)
    contents.refreshed(store, 1, 2)  # the third scan is counted from its files
    plain, quick = store.load(), contents.loaded(store)
    assert quick.contents is not None and plain.contents is None
    for report in (browse.dashboard, lambda i: duplicates.cross_groups(i, ["scan-1", "scan-3"])):
        assert sorted(map(str, report(quick).collect())) == sorted(map(str, report(plain).collect()))
    for request in ({"sort": "OCCURRENCES"}, {"sort": "OBSERVED_BYTES", "limit": 2}, {"min_scans": 2, "descending": False}, {"min_occurrences": 4}, {"size": {"min": 1}}, {"sort": "SCANS", "limit": 1}):
        request = {"scan_ids": [1, 3]} | request
        assert duplicates.group_page(quick, request).collect() == duplicates.group_page(plain, request).collect()
    ours = sorted(map(tuple, contents.copies(quick.contents).collect()))
    assert ours == sorted((r["size"], r["sha256"], r["n"], r["s"]) for r in plain.entries.join(plain.hashes, ["scan_id", "entry_id"]).groupBy("size", "sha256").agg(F.count("*").alias("n"), F.count_distinct("scan_id").alias("s")).collect())


def test_counts_go_when_files_change_without_them(spark, made):
    store, inv = made
    contents.refreshed(store)
    assert set(store.manifest()["tables"]["contents"]) == {"3"}
    base = store.revision()
    store.compact()  # the same rows
    assert contents.missing(store) == []
    # a save that has read counts from before others changed the scan is refused
    store.save(append=True, entries=spark.createDataFrame([(3, 99, 2, "d/z", "z", "FILE", 4, 0, 0)], schemas.SCHEMAS["entries"]))
    assert contents.missing(store) == [3]
    one = spark.createDataFrame([(3, 4, sha("same"), 1)], schemas.STORED["contents"])
    with pytest.raises(Refused, match="changed"):
        store.save(append=True, base=base, contents=one)
    contents.refreshed(store)
    store.save(append=True, hashes=spark.createDataFrame([(3, 99, sha("same"))], schemas.SCHEMAS["hashes"]))
    assert contents.missing(store) == [3]
    contents.refreshed(store)
    assert kept(store) == recount(store) and (3, 4, sha("same"), 3) in kept(store)
    store.save(hashes=inv.hashes.filter("scan_id = 1"))
    assert contents.missing(store) == [1] and store.manifest()["tables"]["contents"] == {}

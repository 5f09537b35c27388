import json

from pyspark.sql import functions as F

import pytest

from tallyvault import cli
from tallyvault.errors import Refused
from tallyvault.inventory import Store
from tallyvault.operators import audit
from tallyvault.sources import discovery


def test_scan_report_and_merge(spark, tmp_path):
    for d in ("one", "two"):
        (tmp_path / d).mkdir()
        for f in ("a", "b"):
            (tmp_path / d / f).write_text("same")

    def call(store, *argv):
        said = []
        return cli.run(spark, ["--store", str(tmp_path / store), *argv], said.append), said

    assert call("s", "scan", "--name", "first", "--root", str(tmp_path / "one"))[0] == cli.OK
    assert call("s", "scan", "--name", "second", "--root", str(tmp_path / "two"), "--discover-only")[0] == cli.OK
    code, said = call("s", "duplicates", "--name", "second")
    assert code == cli.FAILED and json.loads(said[0])["code"] == "INVALID_INVENTORY"
    assert call("s", "hash", "--name", "second")[0] == cli.OK
    code, said = call("s", "duplicates", "--name", "first", "--format", "jsonl")
    assert code == cli.OK and [json.loads(x)["relative_path"] for x in said] == ["a", "b"]
    assert call("s", "duplicates", "--name", "first")[1][0].startswith("2 copies, 4 bytes")
    assert len(call("s", "cross-duplicates", "--scan", "second", "--scan", "first", "--format", "jsonl")[1]) == 4
    assert json.loads(call("s", "status", "--name", "first")[1][0])["hashes"] == 2
    assert call("s", "nonsense")[0] == cli.USAGE and call("s", "status", "--name", "x")[0] == cli.FAILED
    assert call("t", "scan", "--name", "third", "--root", str(tmp_path / "one"))[0] == cli.OK
    assert call("t", "merge-database", "--source", str(tmp_path / "s"))[0] == cli.OK
    assert call("t", "merge-database", "--source", str(tmp_path / "s"))[0] == cli.PARTIAL
    assert len(call("t", "list")[1]) == 3


def test_an_interrupted_discovery_is_resumed(spark, tmp_path):
    """As a walk leaves it that stopped within one directory and had another still to come."""
    root, folder = tmp_path / "root", str(tmp_path / "store")
    for f in ("done/a", "active/b", "active/deep/c", "later/d"):
        (root / f).parent.mkdir(parents=True, exist_ok=True)
        (root / f).write_text("same")
    call = lambda *argv: cli.run(spark, ["--store", folder, *argv], lambda _: None)
    assert call("scan", "--name", "whole", "--root", str(root)) == cli.OK
    assert call("scan", "--name", "cut", "--root", str(root), "--discover-only") == cli.OK
    store = Store(spark, folder)
    inv = store.load()
    mine = F.col("scan_id") == 2
    at = {r["relative_path"]: r["entry_id"] for r in inv.entries.filter(mine).collect()}
    entries = inv.entries.filter(mine & ~F.col("relative_path").isin("active/deep", "active/deep/c", "later/d"))
    dirs = inv.directories.filter(mine & (F.col("relative_path") != "active/deep")).withColumn("completed", ~F.col("relative_path").isin("active", "later"))
    scans = inv.scans.filter(mine).withColumn("active_dir", F.lit(at["active"]).cast("long")).withColumn("phase", F.lit("DISCOVERING"))
    store.save(scan=2, scans=scans, entries=entries, directories=dirs)
    assert call("resume", "--name", "cut") == cli.OK
    after = store.load()
    key = lambda i: sorted((r["relative_path"], r["kind"], r["size"]) for r in after.entries.filter(F.col("scan_id") == i).collect())
    assert key(1) == key(2)
    rows = {r["relative_path"]: r for r in after.entries.filter(mine).collect()}
    assert all(r["parent_id"] == rows[p.rpartition("/")[0]]["entry_id"] for p, r in rows.items() if p) and len({r["entry_id"] for r in rows.values()}) == len(rows)
    assert after.directories.filter(mine & ~F.col("completed")).isEmpty() and after.hashes.filter(mine).count() == 4
    assert after.scans.filter(mine).select("phase", "active_dir").first() == ("COMPLETE", None)


def test_a_killed_walk_is_resumed(spark, tmp_path, monkeypatch):
    """Every round is published; a walk that is killed in one goes on from the last and ends as one that was not."""
    root, folder = tmp_path / "root", str(tmp_path / "store")
    for i in range(6):
        for f in (f"d{i}/a", f"d{i}/sub/b", f"d{i}/sub/deep/c", f"d{i}/sub/deep/er/d", f"d{i}/empty-{i}/x"):
            (root / f).parent.mkdir(parents=True, exist_ok=True)
            (root / f).write_text("same" * i)
    monkeypatch.setattr(discovery, "TASK_ENTRIES", 5)
    monkeypatch.setattr(discovery, "MOST_DIRECTORIES", 4)
    store = Store(spark, folder)
    discovery.begun(store, "whole", str(root))
    discovery.walked(store, "whole")
    discovery.begun(store, "cut", str(root))
    discovery.walked(store, "cut", rounds=2)
    save, before = Store.save, store.revision()

    def killed(self, *args, **tables):
        if "entries" in tables:
            raise KeyboardInterrupt
        return save(self, *args, **tables)

    monkeypatch.setattr(Store, "save", killed)
    with pytest.raises(KeyboardInterrupt):
        discovery.walked(store, "cut")
    monkeypatch.setattr(Store, "save", save)
    assert store.revision() == before
    inv, mine = store.load(), F.col("scan_id") == 2
    seen = inv.entries.filter(mine).count()
    assert 1 < seen < inv.entries.filter("scan_id = 1").count() and not inv.directories.filter(mine & ~F.col("completed")).isEmpty()
    assert audit.counted(audit.entries(inv) | audit.tree(inv)).filter("failures > 0").collect() == []
    assert cli.run(spark, ["--store", folder, "duplicates", "--name", "cut"], lambda _: None) == cli.FAILED
    # what the rounds before had found is not written again
    generations = store.manifest()["tables"]["entries"]["2"]
    assert cli.run(spark, ["--store", folder, "resume", "--name", "cut"], lambda _: None) == cli.OK
    manifest = store.manifest()["tables"]
    assert manifest["entries"]["2"][: len(generations)] == generations and "2" not in manifest["frontier"]
    after = store.load()
    rows = lambda t, i: sorted(tuple(r)[1:] for r in getattr(after, t).filter(F.col("scan_id") == i).collect())
    assert rows("entries", 1) == rows("entries", 2) and rows("directories", 1) == rows("directories", 2) and len(rows("entries", 2)) == 1 + 6 * 10
    assert audit.counted(audit.entries(after) | audit.tree(after)).filter("failures > 0").collect() == []
    assert after.scans.filter(mine).first()["phase"] == "COMPLETE"
    with pytest.raises(Refused):
        discovery.begun(store, "other", str(tmp_path / "nowhere"))


def test_reports_as_files(spark, tmp_path):
    """Parts in the order of their names are what is printed; a comparison hashes what it lacks first."""
    for d in ("one", "two"):
        for i in range(40):
            at = tmp_path / d / f"d{i % 3}" / f"f{i}"
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text("same" * (i % 5) if i % 4 else f"{i % 8}")
    said, told = [], []

    def call(*argv):
        said.clear()
        told.clear()
        return cli.run(spark, ["--store", str(tmp_path / "s"), *argv], said.append, told.append)

    assert call("scan", "--name", "one", "--root", str(tmp_path / "one")) == cli.OK
    assert call("scan", "--name", "two", "--root", str(tmp_path / "two"), "--discover-only") == cli.OK
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for n, (form, *argv) in enumerate((("text", "duplicates", "--name", "one"), ("jsonl", "duplicates", "--name", "one"), ("table", "cross-duplicates", "--scan", "two", "--scan", "one"), ("jsonl", "cross-duplicates", "--scan", "two", "--scan", "one"))):
            assert call(*argv, "--format", form) == cli.OK
            printed = list(said)
            assert call(*argv, "--format", form, "--output", str(tmp_path / f"out{n}")) == cli.OK and not said
            parts = sorted(p for p in (tmp_path / f"out{n}").iterdir() if p.name.startswith("part-"))
            lines = [line for p in parts for line in p.read_text().splitlines()]
            assert len([p for p in parts if p.stat().st_size]) > 1 and len(lines) >= 40
            assert lines == printed if form != "jsonl" else [json.loads(x) for x in lines] == [json.loads(x) for x in printed]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    summary = json.loads(told[0])
    assert summary["event"] == "cross_scan_summary" and not summary["partial"] and summary["pending_files"] == 0
    assert Store(spark, str(tmp_path / "s")).load().hashes.filter("scan_id = 2").count() == 40
    assert call("resume", "--name", "two", "--discover-only") == cli.OK
    assert call("images", "--name", "one", "--provider", "no.such:thing") == cli.FAILED and json.loads(said[0])["code"] == "CAPABILITY"
    assert call("images", "--name", "one", "--provider", "tallyvault.sources.image_headers:Fixture") == cli.OK
    assert call("image-status", "--name", "one") == cli.OK and json.loads(said[0])["phase"] == "COMPLETE"

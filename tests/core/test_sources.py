import io
import os
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyvault import schemas
from tallyvault.inventory import Inventory, Store
from tallyvault.operators import audit, duplicates
from tallyvault.sources import archive_files, filesystem, hashing, image_headers
from tallyvault.streaming import ingest


def test_discover_hash_and_report(spark, tmp_path):
    root = tmp_path / "root"
    for p, body in {"alpha/a.txt": "same", "beta/b.bin": "same", "beta/deep/c": "else", "own.db": "db", "unique": "longer than the others"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(body)
    os.symlink("unique", root / "link")
    os.utime(root / "unique", ns=(0, 1_700_000_000_123_456_789))
    entries, errors = filesystem.discover(spark, str(root), 1, [str(root / "own.db")])
    rows = {r["relative_path"]: r for r in entries.collect()}
    assert set(rows) == {"", "alpha", "beta", "alpha/a.txt", "beta/b.bin", "beta/deep", "beta/deep/c", "link", "unique"} and errors.isEmpty()
    assert rows["link"]["kind"] == "SYMLINK" and rows[""]["entry_id"] == 1 and rows["alpha/a.txt"]["parent_id"] == rows["alpha"]["entry_id"]
    assert (rows["unique"]["modified_sec"], rows["unique"]["modified_nano"]) == (1_700_000_000, 123_456_789)
    scans = spark.createDataFrame([(1, "one", str(root), "COMPLETE", "SHA-256", None, 100, None, None)], schemas.SCHEMAS["scans"])
    (root / "beta/deep/c").unlink()
    hashes, failed = hashing.hashed(entries.filter("kind = 'FILE'"), scans)
    assert [(r["relative_path"], r["message"]) for r in failed.collect()] == [("beta/deep/c", "FILE_MISSING")] and hashes.count() == 3
    dirs = entries.filter("kind = 'DIRECTORY'").select("scan_id", "entry_id", "parent_id", "relative_path", F.lit(True).alias("completed"))
    inv = Inventory(spark, {"scans": scans, "entries": entries, "directories": dirs, "hashes": hashes, "scan_errors": failed})
    assert {r["relative_path"] for r in duplicates.report(inv, "one").collect()} == {"alpha/a.txt", "beta/b.bin"}
    audit.require(inv)


def test_deep_trees_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(filesystem, "ENOUGH", 4)
    for i in range(6):
        (tmp_path / f"only/one/way/d{i}/e").mkdir(parents=True)
        (tmp_path / f"only/one/way/d{i}/e/f").write_text("x")
    (tmp_path / "only/g").write_text("y")
    reader = filesystem.TreeReader({"path": str(tmp_path)})
    tasks = reader.partitions()
    assert sum(t.deep for t in tasks) == 6
    found = sorted(r[0] for t in tasks for r in reader.read(t))
    want = sorted(os.path.relpath(os.path.join(d, n), tmp_path) for d, folders, files in os.walk(tmp_path) for n in [*folders, *files])
    assert found == ["", *want]
    entries, _ = filesystem.discover(spark, str(tmp_path), 1)
    rows = {r["relative_path"]: r for r in entries.collect()}
    assert sorted(rows) == found and all(r["parent_id"] == rows[p.rpartition("/")[0]]["entry_id"] < r["entry_id"] for p, r in rows.items() if p)
    with pytest.raises(OSError):
        filesystem.TreeReader({"path": str(tmp_path / "none")}).partitions()


def test_checked_hashes(tmp_path):
    f = tmp_path / "f"
    f.write_text("same")
    t = divmod(f.stat().st_mtime_ns, 10**9)
    assert hashing.checked(str(f), 4, *t)[1] is None
    assert hashing.checked(str(f), 5, *t) == (None, "SOURCE_CHANGED")
    assert hashing.checked(str(f), 4, *t, hasher=lambda p, b: ("0" * 64, 3)) == (None, "SOURCE_CHANGED")
    assert hashing.checked(str(tmp_path), 4, *t) == (None, "NOT_REGULAR_ANYMORE")


def test_foreign_roots_are_not_read(spark):
    scans = spark.createDataFrame([(1, "C:/x")], "scan_id long, root string")
    files = spark.createDataFrame([(1, 2, "f", 1, 0, 0)], "scan_id long, entry_id long, relative_path string, size long, modified_sec long, modified_nano int")
    hashes, errors = hashing.hashed(files, scans)
    assert hashes.isEmpty() and errors.first()["message"] == "FOREIGN_ROOT"


@pytest.mark.parametrize("bad", ["/abs", "a/../b", "a\\b", "c:/x", "a\0b", "x" * 40_000, b"\xff"])
def test_unsafe_members(bad):
    with pytest.raises((archive_files.Unsafe, UnicodeDecodeError)):
        archive_files.safe_path(bad)


def test_archives(spark, tmp_path):
    assert archive_files.safe_path("./a//b/") == "a/b"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/one.txt", "same")
        z.writestr("../out", "evil")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("two.txt")
        info.size = 4
        t.addfile(info, io.BytesIO(b"same"))
    (tmp_path / "c.rar").write_bytes(b"Rar!....")
    (tmp_path / "d.zip").write_bytes(b"PK\3\4 broken")
    rows = {(r["path"].rpartition("/")[2], r["ordinal"]): r for r in archive_files.extracted(spark, str(tmp_path)).collect()}
    assert rows["a.zip", 1]["sha256"] == rows["b.tar.gz", 1]["sha256"] and rows["a.zip", 1]["integrity"] == "READ_OK"
    assert rows["a.zip", 2]["category"] == "SAFETY" and rows["c.rar", 0]["category"] == "CAPABILITY" and rows["d.zip", 0]["integrity"] == "UNREADABLE"


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def _tar(members, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, body in members.items():
            info = tarfile.TarInfo(name)
            if isinstance(body, tuple):
                info.type, info.linkname = tarfile.LNKTYPE, body[0]
                t.addfile(info)
            else:
                info.size = len(body)
                t.addfile(info, io.BytesIO(body))
    return out.getvalue()


def test_archives_of_a_scan_are_analysed(spark, tmp_path):
    import json

    from tallyvault import cli
    from tallyvault.operators import archives

    root, folder = tmp_path / "root", str(tmp_path / "store")
    deep = _tar({"leaf.txt": b"same", "twin.txt": ("leaf.txt",)})
    inner = _zip({"deep.tar.gz": deep, "note": b"note"})
    cut = _zip({"x": b"y" * 5000})
    files = {
        "a.zip": _zip({"inner.zip": inner, "again/inner.zip": inner, "t": b"t"}), "copy-of-a.zip": None, "b.tar.gz": _tar({"deep.tar.gz": deep, "../out": b"evil"}), "c.rar": b"Rar!....", "d.zip.001": cut[:100], "d.zip.002": cut[100:],
        "e.part2.rar": b"Rar!", "f.zip": b"PK\3\4 broken", "plain.txt": b"same",
    }
    files["copy-of-a.zip"] = files["a.zip"]
    root.mkdir()
    for name, body in files.items():
        (root / name).write_bytes(body)
    said = []
    call = lambda *argv: cli.run(spark, ["--store", folder, *argv], said.append)
    assert call("scan", "--name", "one", "--root", str(root)) == cli.OK and call("archives", "--name", "one") == cli.PARTIAL
    inv = Store(spark, folder).load()
    jobs = {r["group_key"]: r for r in inv.archive_jobs.collect()}
    assert {k: (r["status"], r["duplicate"], r["diagnostic"]) for k, r in jobs.items()} == {
        "zip-split:a": ("COMPLETE", False, None), "zip-split:copy-of-a": ("COMPLETE", True, None), "single:b.tar.gz": ("PARTIAL", False, None), "rar-old:c": ("PARTIAL", False, None),
        "zip-chunks:d.zip": ("COMPLETE", False, None), "rar-parts:e": ("PARTIAL", False, "volumes are missing"), "zip-split:f": ("PARTIAL", False, None),
    }
    assert jobs["zip-split:a"]["result_id"] == jobs["zip-split:copy-of-a"]["result_id"]
    results = {r["result_id"]: r for r in inv.archive_results.collect()}
    top = results[jobs["zip-split:a"]["result_id"]]
    assert (top["height"], top["reusable"], top["state"]) == (2, True, "COMPLETE")
    members = {r["relative_path"]: r for r in archives.members(inv, top["result_id"]).collect()}
    assert members["inner.zip"]["sha256"] == members["again/inner.zip"]["sha256"]
    nested = {r["group_key"]: r for r in inv.archive_nested.filter(F.col("parent_result_id") == top["result_id"]).collect()}
    assert not nested["zip-split:inner"]["duplicate"] and nested["zip-split:again/inner"]["duplicate"]
    # the same deep.tar.gz, met by two tasks, is one result; its hard link is told of, not read
    deepest = [r for r in results.values() if r["height"] == 0 and r["fingerprint"].startswith("file-sha256:") and inv.archive_members.filter((F.col("result_id") == r["result_id"]) & (F.col("relative_path") == "leaf.txt")).count() == 1]
    assert len(deepest) == 1
    leaf = {r["relative_path"]: (r["kind"], r["sha256"]) for r in inv.archive_members.filter(F.col("result_id") == deepest[0]["result_id"]).collect()}
    assert leaf["twin.txt"] == ("HARDLINK", None) and leaf["leaf.txt"][1] is not None
    # heights, states and flags are those that the operator derives from the rows
    facts = inv.archive_nested.join(inv.archive_results.select(F.col("result_id").alias("child_result_id"), F.col("reusable").alias("child_reusable"), F.col("retryable").alias("child_retryable"), F.col("height").alias("child_height")), "child_result_id").withColumnRenamed("parent_result_id", "result_id")
    derived = {r["result_id"]: r for r in archives.outcome(inv.archive_errors, inv.archive_results.select("result_id", F.lit(True).alias("ended"), F.lit(True).alias("whole")), facts).collect()}
    assert all((derived[k]["state"], derived[k]["retryable"], derived[k]["reusable"], derived[k]["height"]) == (r["state"], r["retryable"], r["reusable"], r["height"]) for k, r in results.items())
    assert {(r["category"], r["code"]) for r in inv.archive_errors.collect()} == {("SAFETY", "UNSAFE_PATH"), ("CAPABILITY", "UNSUPPORTED"), ("CONTENT", "HEADER")}
    said.clear()
    assert call("archive-status", "--name", "one") == cli.OK
    assert json.loads(said[0])["root_archives"] == 7 and json.loads(said[0])["nested_archives"] == 4
    assert [r["ordinal"] for r in archives.volumes(inv, jobs["zip-chunks:d.zip"]["result_id"]).collect()] == [1, 2]
    broken = {k for k, v in audit.counted(audit.archive(inv)).filter("failures > 0").collect()}
    assert broken == set(), broken
    # a second run reads nothing that can be used again
    assert call("archives", "--name", "one") == cli.PARTIAL
    again = Store(spark, folder).load()
    after = {r["group_key"]: r for r in again.archive_jobs.collect()}
    assert after["zip-split:a"]["result_id"] == jobs["zip-split:a"]["result_id"] and after["zip-split:a"]["duplicate"]
    assert after["single:b.tar.gz"]["result_id"] == jobs["single:b.tar.gz"]["result_id"] and after["rar-old:c"]["result_id"] != jobs["rar-old:c"]["result_id"]
    # limits: other limits, other results
    assert call("archives", "--name", "one", "--depth", "1", "--member-bytes", "4000") == cli.PARTIAL
    last = Store(spark, folder).load()
    own = last.archive_jobs.select("result_id").distinct()
    codes = {r["code"] for r in last.archive_errors.join(own, "result_id", "left_semi").collect()} | {r["code"] for r in last.archive_errors.join(archives.reached(last, 1), "result_id", "left_semi").collect()}
    assert {"DEPTH", "MEMBER_BYTES"} <= codes
    assert not last.archive_results.join(own, "result_id", "left_semi").filter("source_label like '%/a.zip'").first()["reusable"]


def analysed_tree(spark, tmp_path, files, limits, name="one"):
    """The archive tables of a tree of files under limits, and its jobs and results by key; audited."""
    from tallyvault import cli
    from tallyvault.sources import archive_run

    root, folder = tmp_path / "root", str(tmp_path / "store")
    root.mkdir(exist_ok=True)
    for path, body in files.items():
        (root / path).write_bytes(body)
    assert cli.run(spark, ["--store", folder, "scan", "--name", name, "--root", str(root)], lambda _: None) == cli.OK
    archive_run.publish(Store(spark, folder), name, limits)
    inv = Store(spark, folder).load()
    broken = {k for k, v in audit.counted(audit.archive(inv)).filter("failures > 0").collect()}
    assert broken == set(), broken
    return inv, {r["group_key"]: r for r in inv.archive_jobs.collect()}, {r["result_id"]: r for r in inv.archive_results.collect()}


def below(inv, result):
    return {r["group_key"]: r["child_result_id"] for r in inv.archive_nested.filter(F.col("parent_result_id") == result).collect()}


def test_one_content_met_at_several_depths(spark, tmp_path):
    """What the levels cut short is a result of its own; heights descend, and whole results are one whatever depth they were met at."""
    y = _zip({"leaf": b"leaf"})
    x = _zip({"y.zip": y})
    inv, jobs, results = analysed_tree(spark, tmp_path, {"x.zip": x, "a.zip": _zip({"x.zip": x}), "b.zip": _zip({"a.zip": _zip({"x.zip": x})}), "y.zip": y}, archive_files.Limits(depth=1))
    own = {k: results[r["result_id"]] for k, r in jobs.items()}
    facts = {k: (r["state"], r["reusable"], r["height"]) for k, r in own.items()}
    assert facts == {"zip-split:y": ("COMPLETE", True, 0), "zip-split:x": ("COMPLETE", True, 1), "zip-split:a": ("PARTIAL", False, 2), "zip-split:b": ("PARTIAL", False, 2)}
    # x below a.zip looks at no level more: another result than x.zip, of the same content
    cut = results[below(inv, own["zip-split:a"]["result_id"])["zip-split:x"]]
    assert cut["fingerprint"] == own["zip-split:x"]["fingerprint"] and cut["result_id"] != own["zip-split:x"]["result_id"] and (cut["state"], cut["height"]) == ("PARTIAL", 1)
    assert below(inv, own["zip-split:x"]["result_id"])["zip-split:y"] == own["zip-split:y"]["result_id"]
    codes = {r["result_id"]: (r["category"], r["code"]) for r in inv.archive_errors.collect()}
    assert codes[own["zip-split:a"]["result_id"]] == codes[cut["result_id"]] == ("CHILD", "NESTED_ERRORS")
    assert codes[below(inv, cut["result_id"])["zip-split:y"]] == ("LIMIT", "DEPTH")
    # with levels enough nothing is cut, and every content is one result
    inv, jobs, results = analysed_tree(spark, tmp_path, {}, archive_files.Limits(depth=3), "two")
    mine = inv.archive_results.filter("scan_id = 2").collect()
    assert len(mine) == len({r["fingerprint"] for r in mine}) == 4 and {(r["state"], r["height"]) for r in mine} == {("COMPLETE", h) for h in range(4)}


def test_errors_below_are_told_above(spark, tmp_path):
    sick = _zip({"d.zip": b"PK\3\4 broken", "fine": b"fine"})
    inv, jobs, results = analysed_tree(spark, tmp_path, {"a.zip": _zip({"mid.zip": sick, "t": b"t"})}, archive_files.Limits())
    top = results[jobs["zip-split:a"]["result_id"]]
    mid = results[below(inv, top["result_id"])["zip-split:mid"]]
    assert (top["state"], mid["state"], top["height"], mid["height"]) == ("PARTIAL", "PARTIAL", 2, 1)
    told = {(r["category"], r["code"], r["ordinal"]) for r in inv.archive_errors.filter(F.col("result_id") == top["result_id"]).collect()}
    assert told == {("CHILD", "NESTED_ERRORS", 1)}


def test_volumes_that_changed_give_no_result(spark, tmp_path):
    from tallyvault.sources import archive_run

    inv, jobs, _ = analysed_tree(spark, tmp_path, {"a.zip": _zip({"t": b"t"}), "b.zip": _zip({"u": b"u"})}, archive_files.Limits())
    (tmp_path / "root" / "a.zip").write_bytes(_zip({"t": b"other", "more": b"more"}))
    made = archive_run.analysed(inv.with_tables(archive_results=inv.archive_results.limit(0)), "one")
    again = {r["group_key"]: r for r in made["archive_jobs"].collect()}
    assert again["zip-split:a"]["status"] == "PARTIAL" and again["zip-split:a"]["result_id"] is None and "changed" in again["zip-split:a"]["diagnostic"]
    assert again["zip-split:b"]["status"] == "COMPLETE" and made["archive_results"].count() == 1 and made["archive_members"].count() == 1


def test_volumes_within_an_archive_are_joined(spark, tmp_path, monkeypatch):
    """Chunks of a zip within a zip are one archive, read to its members, wherever its bytes are kept."""
    inner = _zip({"leaf": b"leaf" * 400, "deep.zip": _zip({"x": b"x"})})
    cut = [inner[:300], inner[300:700], inner[700:]]
    parts = {f"p/d.zip.{i:03}": body for i, body in enumerate(cut, 1)}
    shuffled = {k: parts[k] for k in sorted(parts, reverse=True)}
    files = {
        "a.zip": _zip({"note": b"note", **shuffled}), "b.tar.gz": _tar(parts), "d.zip.001": cut[0], "d.zip.002": cut[1], "d.zip.003": cut[2],
        "gap.zip": _zip({k: v for k, v in parts.items() if not k.endswith("2")}), "split.zip": _zip({"s.z01": b"PK", "s.zip": b"PK"}),
    }
    for memory in (1 << 26, 100):
        monkeypatch.setattr(archive_files.Scratch.__init__, "__defaults__", (None, memory))
        name = f"scan-{memory}"
        inv, jobs, results = analysed_tree(spark, tmp_path, files, archive_files.Limits(), name)
        inv = inv.with_tables(archive_jobs=inv.archive_jobs.filter(F.col("scan_id") == inv.scans.filter(F.col("name") == name).first()["scan_id"]))
        jobs = {r["group_key"]: r for r in inv.archive_jobs.collect()}
        own = {k: results[r["result_id"]] for k, r in jobs.items()}
        assert {k: (r["state"], r["height"]) for k, r in own.items()} == {
            "zip-split:a": ("COMPLETE", 2), "single:b.tar.gz": ("COMPLETE", 2), "zip-chunks:d.zip": ("COMPLETE", 1), "zip-split:gap": ("PARTIAL", 0), "zip-split:split": ("PARTIAL", 0)
        }
        # the set is one content, in a scan and in two kinds of archives
        child = below(inv, own["zip-split:a"]["result_id"])["zip-chunks:p/d.zip"]
        assert child == below(inv, own["single:b.tar.gz"]["result_id"])["zip-chunks:p/d.zip"] == jobs["zip-chunks:d.zip"]["result_id"]
        assert {r["relative_path"] for r in inv.archive_members.filter(F.col("result_id") == child).collect()} == {"leaf", "deep.zip"}
        codes = {r["result_id"]: r["code"] for r in inv.archive_errors.collect()}
        assert codes[own["zip-split:gap"]["result_id"]] == "MISSING_VOLUMES" and codes[own["zip-split:split"]["result_id"]] == "UNSUPPORTED"


@pytest.mark.parametrize(("flavor", "slots"), [("single", [0]), ("zip-split", [0]), ("zip-split", [1, 0]), ("zip-split", [2, 0]), ("zip-split", [1]), ("zip-split", [1, 1, 0]), ("zip-chunks", [1, 2]), ("zip-chunks", [2, 3]), ("zip-chunks", [1, 3]), ("rar-old", [0, 1]), ("rar-old", [1, 2]), ("rar-parts", [1, 1]), ("rar-old", [0]), ("7z-split", [1])])
def test_a_set_in_hand_is_arranged_as_a_table_is(spark, flavor, slots):
    from tallyvault.operators import archives

    row = archives.arranged(spark.createDataFrame([(1, "g", flavor, s) for s in slots], "scan_id long, group_key string, flavor string, slot int")).first()
    assert archives.arrangement(flavor, slots) == (row["missing"], row["ambiguous"], row["reader_flavor"])


def test_zst_archives(tmp_path):
    zstandard = pytest.importorskip("zstandard")
    body = zstandard.ZstdCompressor().compress(_tar({"one": b"same", "two": ("one",)}, "w"))
    rows = [r for r, _ in archive_files.walked("a.tar.zst", io.BytesIO(body), len(body))]
    assert [(r[1], r[2], r[7]) for r in rows] == [("one", "FILE", "READ_OK"), ("two", "HARDLINK", "METADATA")]
    ((row, kept),) = archive_files.walked("b.zst", io.BytesIO(zstandard.ZstdCompressor().compress(b"same")), 20, wanted=lambda p: True)
    assert (row[1], row[4], kept.open().read()) == ("b", 4, b"same")


def test_image_headers(spark, tmp_path):
    name = b"base.img"
    (tmp_path / "a.qcow2").write_bytes(struct.pack(">4sIQIIQI", b"QFI\xfb", 3, 104, len(name), 16, 1 << 30, 0).ljust(104, b"\0") + name)
    (tmp_path / "b.vmdk").write_bytes(b'# Disk DescriptorFile\nparentFileNameHint="p.vmdk"\nRW 8 FLAT "e-1.vmdk" 0\n')
    (tmp_path / "c.raw").write_bytes(b"\0" * 700)
    rows = {r["path"].rpartition("/")[2]: r for r in image_headers.headers(spark, str(tmp_path)).collect()}
    assert (rows["a.qcow2"]["format"], rows["a.qcow2"]["backing"], rows["a.qcow2"]["virtual_size"]) == ("qcow2", "base.img", 1 << 30)
    assert (rows["b.vmdk"]["backing"], rows["b.vmdk"]["extents"], rows["b.vmdk"]["virtual_size"]) == ("p.vmdk", ["e-1.vmdk"], 4096)
    assert rows["c.raw"]["format"] == "raw"


def test_images_of_a_scan_are_analysed(spark, tmp_path):
    from tallyvault import cli
    from tallyvault.operators import images
    from tallyvault.sources import image_run

    root, folder = tmp_path / "root", str(tmp_path / "store")
    root.mkdir()

    def qcow(backing):
        name = backing.encode()
        return struct.pack(">4sIQIIQI", b"QFI\xfb", 3, 104 if name else 0, len(name), 16, 1 << 30, 0).ljust(104, b"\0") + name

    files = {"a.qcow2": qcow("base.qcow2"), "b.qcow2": qcow("base.qcow2"), "base.qcow2": qcow(""), "lost.qcow2": qcow("gone.qcow2"), "x.qcow2": qcow("y.qcow2"), "y.qcow2": qcow("x.qcow2"), "sick.img": b"\0" * 700, "note.txt": b"-"}
    for name, body in files.items():
        (root / name).write_bytes(body)
    provider = image_headers.Fixture({
        "image_filesystems": [{"image": "a.qcow2", "filesystem_id": 1, "device": "/dev/sda1", "type": "ext4", "state": "COMPLETE"}],
        "image_entries": [{"image": "a.qcow2", "filesystem_id": 1, "entry_id": 2, "relative_path": "etc/x", "filename": "x", "kind": "FILE", "size": 4, "actual_size": 4, "sha256": "0" * 64, "integrity": "READ_OK"}],
        "image_errors": [{"image": "sick.img", "category": "FILESYSTEM", "code": "MOUNT", "message": "cannot be mounted"}],
    })
    assert cli.run(spark, ["--store", folder, "scan", "--name", "one", "--root", str(root)], print) == cli.OK
    store = Store(spark, folder)
    assert image_run.publish(store, "one", provider, "fixture") == "COMPLETE_WITH_ERRORS"
    inv = store.load()
    jobs = {r["relative_path"]: r for r in inv.image_jobs.collect()}
    assert {k: (r["state"], r["duplicate"]) for k, r in jobs.items()} == {
        "a.qcow2": ("COMPLETE", False), "b.qcow2": ("COMPLETE", True), "base.qcow2": ("COMPONENT", False), "lost.qcow2": ("PARTIAL", False), "x.qcow2": ("PARTIAL", False), "y.qcow2": ("PARTIAL", False), "sick.img": ("PARTIAL", False),
    }
    assert jobs["x.qcow2"]["diagnostic"] == "an image depends on itself"
    assert jobs["a.qcow2"]["result_id"] == jobs["b.qcow2"]["result_id"] and jobs["base.qcow2"]["component_of"] == jobs["a.qcow2"]["source_id"]
    assert "MISSING_COMPONENT" in jobs["lost.qcow2"]["diagnostic"]
    tree = {(r["ordinal"], r["parent_ordinal"], r["role"]) for r in images.component_tree(inv).filter(F.col("result_id") == jobs["a.qcow2"]["result_id"]).collect()}
    assert tree == {(0, -1, "PRIMARY"), (1, 0, "BACKING")}
    assert images.detail(inv, "image_entries", jobs["a.qcow2"]["result_id"]).count() == 1
    assert [r["code"] for r in images.errors(inv, "one").filter("code = 'MOUNT'").collect()] == ["MOUNT"]
    # a second scan of the same files asks for nothing that is known

    class Counting:
        def rows(self, table, image):
            raise AssertionError(f"{image} was asked for")

    (root / "sick.img").unlink()
    assert cli.run(spark, ["--store", folder, "scan", "--name", "two", "--root", str(root)], print) == cli.OK
    image_run.publish(store, "two", Counting(), "fixture")
    again = {r["relative_path"]: r for r in store.load().image_jobs.filter("scan_id = 2").collect()}
    assert again["a.qcow2"]["result_id"] == jobs["a.qcow2"]["result_id"] and again["a.qcow2"]["duplicate"]


def test_streamed_hashes_come_in_once(spark, tmp_path):
    tables = {t: spark.createDataFrame([], schemas.SCHEMAS[t]) for t in schemas.BASE}
    tables["entries"] = spark.createDataFrame([(1, 2, 1, "f", "f", "FILE", 1, 0, 0), (1, 3, 1, "g", "g", "FILE", 1, 0, 0)], schemas.SCHEMAS["entries"])
    store = Store(spark, str(tmp_path / "store"))
    store.save(**tables)
    for name, entry in (("one", 2), ("two", 2), ("three", 3)):
        spark.createDataFrame([(1, entry, "0" * 64)], schemas.SCHEMAS["hashes"]).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.hashes(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["entry_id"] for r in store.load().hashes.collect()) == [2, 3]

"""SHA-256 of files, checked against what the inventory says of them before and after reading."""

from __future__ import annotations

import errno
import hashlib
import os
import stat
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvault.functions import paths
from tallyvault.storage import settle

BUFFER = 1 << 20
#: A hasher reads a whole file: (path, buffer size) -> (hexadecimal digest, bytes read).
Hasher = Callable[[str, int], tuple[str, int]]


def sha256(path: str, buffer: int = BUFFER) -> tuple[str, int]:
    digest, n = hashlib.sha256(), 0
    with open(path, "rb", buffering=0) as f:
        block = bytearray(buffer)
        view = memoryview(block)
        while read := f.readinto(block):
            digest.update(view[:read])
            n += read
    return digest.hexdigest(), n


def checked(path: str, size: int, seconds: int, nanos: int, hasher: Hasher = sha256, buffer: int = BUFFER) -> tuple[str | None, str | None]:
    """(digest, None) or (None, error code)."""

    def look() -> str | None:
        s = os.lstat(path)
        if not stat.S_ISREG(s.st_mode):
            return "NOT_REGULAR_ANYMORE"
        return None if (s.st_size, s.st_mtime_ns) == (size, seconds * 1_000_000_000 + nanos) else "SOURCE_CHANGED"

    try:
        if wrong := look():
            return None, wrong
        digest, n = hasher(path, buffer)
        if wrong := look():
            return None, wrong
    except OSError as e:
        return None, {errno.ENOENT: "FILE_MISSING", errno.EACCES: "PERMISSION_DENIED", errno.EPERM: "PERMISSION_DENIED"}.get(e.errno, "READ_ERROR")
    if n != size:
        return None, "SOURCE_CHANGED"
    if len(digest) != 64 or digest.strip("0123456789abcdef"):
        return None, "READ_ERROR"
    return digest, None


def hashed(files: DataFrame, scans: DataFrame, hasher: Hasher = sha256, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """hashes and scan_errors for candidate files; those under a root of another system are refused, not read.

    Files are dealt so that each partition gets about the same bytes.
    """
    rows = files.join(F.broadcast(scans.select("scan_id", "root")), "scan_id").withColumn("style", paths.style(F.col("root")))
    rows = rows.select("scan_id", "entry_id", "relative_path", "size", "modified_sec", "modified_nano", "root", "style")
    rows = rows.repartition(partitions or 4 * rows.sparkSession.sparkContext.defaultParallelism, F.xxhash64("scan_id", "entry_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                found = (None, "FOREIGN_ROOT") if r.style != paths.POSIX else checked(os.path.join(r.root, r.relative_path), int(r.size), int(r.modified_sec), int(r.modified_nano), hasher)
                out.append((r.scan_id, r.entry_id, r.relative_path, *found))
            yield pd.DataFrame(out, columns=["scan_id", "entry_id", "relative_path", "sha256", "code"])

    done = settle(rows.mapInPandas(run, "scan_id long, entry_id long, relative_path string, sha256 string, code string"))  # no file is read twice
    errors = done.filter("code is not null").select("scan_id", F.lit("HASHING").alias("phase"), "relative_path", F.col("code").alias("message"), F.unix_millis(F.current_timestamp()).alias("recorded_at_ms"))
    return done.filter("sha256 is not null").select("scan_id", "entry_id", "sha256"), errors

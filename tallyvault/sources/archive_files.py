"""Members of archives, read with the standard library: zip, tar and its compressed forms, and single compressed files.

rar and 7z need tools that are not here and give a CAPABILITY error; so does zst where the
zstandard module is missing.  Archives are read by seeking and members as streams, within
limits on their number, their bytes and how much larger they are than the archive.
"""

from __future__ import annotations

import bz2
import gzip
import hashlib
import io
import lzma
import os
import tarfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_PATH = 32_768
BLOCK = 1 << 20
SCHEMA = "path string, ordinal long, relative_path string, kind string, declared_size long, actual_size long, modified_sec long, sha256 string, integrity string, encrypted boolean, category string, code string, message string"
BROKEN = (OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, lzma.LZMAError, NotImplementedError, ValueError, RuntimeError)


@dataclass(frozen=True)
class Limits:
    """Members of an archive, bytes of a member and of all, bytes of all over the archive's own, levels of archives within archives, and bytes of such a one."""

    members: int = 1_000_000
    member_bytes: int = 1 << 36
    total_bytes: int = 1 << 40
    ratio: int = 10_000
    depth: int = 8
    nested_bytes: int = 1 << 28


class Unsafe(ValueError):
    pass


class LimitHit(Exception):
    pass


def safe_path(name: str | bytes) -> str:
    """A member's name as a relative path: empty and `.` parts go; what could lead outside is refused."""
    text = name.decode("utf-8", "strict") if isinstance(name, bytes) else name
    if len(text.encode("utf-8", "surrogatepass")) > MOST_PATH:
        raise Unsafe("too long")
    if text.startswith("/") or "\\" in text or "\0" in text or (len(text) > 1 and text[1] == ":" and text[0].isalpha()):
        raise Unsafe("not relative")
    if any("\ud800" <= c <= "\udfff" for c in text):
        raise Unsafe("not UTF-8")
    parts = [p for p in text.split("/") if p not in ("", ".")]
    if ".." in parts:
        raise Unsafe("leads outside")
    return "/".join(parts)


class Kept:
    """The bytes of a member, in memory or in a file; opened as often as needed, and dropped once."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.size, self.blocks, self.path, self.file = scratch, 0, [], None, None

    def write(self, block: bytes) -> bool:
        """Whether there is room for it."""
        self.size += len(block)
        if self.file is None and len(block) <= self.scratch.memory:
            self.scratch.memory -= len(block)
            self.blocks.append(block)
            return True
        if self.file is None:
            if self.scratch.folder is None:
                return False
            os.makedirs(self.scratch.folder, exist_ok=True)
            self.path = os.path.join(self.scratch.folder, uuid.uuid4().hex)
            self.file = open(self.path, "wb")  # noqa: SIM115
            for b in self.blocks:
                self.file.write(b)
            self._free()
        self.file.write(block)
        return True

    def _free(self) -> None:
        self.scratch.memory += sum(map(len, self.blocks))
        self.blocks = []

    def finish(self) -> None:
        if self.file is not None:
            self.file.close()

    def open(self) -> BinaryIO:
        return io.BytesIO(b"".join(self.blocks)) if self.path is None else open(self.path, "rb")

    def drop(self) -> None:
        self.finish()
        self._free()
        if self.path is not None:
            os.unlink(self.path)
            self.path = None


@dataclass
class Scratch:
    """Room for members that are read again: so many bytes of memory, and a folder that executors share, if there is one that files can be opened in."""

    folder: str | None = None
    memory: int = 1 << 26


class Budget:
    """What is left of an archive's bytes."""

    def __init__(self, size: int, limits: Limits, scratch: Scratch | None = None):
        self.limits, self.left = limits, min(limits.total_bytes, limits.ratio * max(size, 1) + BLOCK)
        self.scratch = scratch or Scratch()

    def read(self, stream: BinaryIO, keep: bool) -> tuple[str, int, Kept | None]:
        kept = Kept(self.scratch) if keep else None
        try:
            return self._read(stream, kept)
        except BaseException:
            if kept is not None:
                kept.drop()
            raise

    def _read(self, stream: BinaryIO, held: Kept | None) -> tuple[str, int, Kept | None]:
        digest, n = hashlib.sha256(), 0
        while block := stream.read(BLOCK):
            digest.update(block)
            n += len(block)
            self.left -= len(block)
            if n > self.limits.member_bytes:
                raise LimitHit("MEMBER_BYTES")
            if self.left < 0:
                raise LimitHit("TOTAL_BYTES")
            if held is not None and (n > self.limits.nested_bytes or not held.write(block)):
                held.drop()
                held = None
        if held is not None:
            held.finish()
        return digest.hexdigest(), n, held


def _member(ordinal: int, name: str | bytes, kind: str, declared: int | None, seconds: int | None, opened: Callable[[], BinaryIO | None], budget: Budget, wanted: Callable[[str], bool], encrypted: bool = False) -> tuple[tuple, Kept | None]:
    """One member and perhaps its bytes, or what is wrong with it; the others are still read."""
    empty = (None, None)
    try:
        path = safe_path(name)
    except (Unsafe, UnicodeDecodeError) as e:
        return (ordinal, None, kind, declared, None, seconds, None, "SKIPPED", encrypted, "SAFETY", "UNSAFE_PATH", str(e)), None
    if kind != "FILE":
        return (ordinal, path, kind, declared, None, seconds, None, "METADATA", encrypted, None, *empty), None
    if encrypted:
        return (ordinal, path, kind, declared, None, seconds, None, "ENCRYPTED", True, "CAPABILITY", "ENCRYPTED", "a password is needed"), None
    try:
        with opened() as stream:
            digest, n, body = budget.read(stream, wanted(path))
    except LimitHit as e:
        return (ordinal, path, kind, declared, None, seconds, None, "SKIPPED", False, "LIMIT", str(e), "the member goes over a limit"), None
    except BROKEN as e:
        return (ordinal, path, kind, declared, None, seconds, None, "DAMAGED", False, "CONTENT", "READ", str(e)), None
    if declared is not None and n != declared:
        if body is not None:
            body.drop()
        return (ordinal, path, kind, declared, n, seconds, None, "DAMAGED", False, "CONTENT", "SIZE", "the size is not as declared"), None
    return (ordinal, path, kind, declared, n, seconds, digest, "READ_OK", False, None, *empty), body


def _zst(data: BinaryIO) -> BinaryIO | None:
    try:
        import zstandard
    except ImportError:
        return None
    return zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True, closefd=False)


def walked(name: str, data: BinaryIO, size: int, limits: Limits = Limits(), wanted: Callable[[str], bool] = lambda path: False, scratch: Scratch | None = None) -> Iterator[tuple[tuple, Kept | None]]:  # noqa: B008
    """Members in order and errors, as rows without the archive's path, each with its bytes if they are wanted."""
    lower, budget = name.lower(), Budget(size, limits, scratch)

    def failure(category: str, code: str, e: object) -> tuple[tuple, None]:
        return (0, None, "OTHER", None, None, None, None, "UNREADABLE", False, category, code, str(e)), None

    too_many = failure("LIMIT", "MEMBERS", f"more than {limits.members} members")
    try:
        head = data.read(262)
        data.seek(0)
        if lower.endswith((".rar", ".7z")) or head[:4] == b"Rar!" or head[:6] == b"7z\xbc\xaf'\x1c":
            yield failure("CAPABILITY", "UNSUPPORTED", "rar and 7z need other tools")
        elif head[:2] == b"PK" or (head[257:262] != b"ustar" and zipfile.is_zipfile(data)):
            with zipfile.ZipFile(data) as z:
                for i, m in enumerate(z.infolist()[: limits.members], 1):
                    kind = "DIRECTORY" if m.is_dir() else "SYMLINK" if (m.external_attr >> 28) == 0xA else "FILE"
                    yield _member(i, m.filename, kind, m.file_size, None, lambda m=m: z.open(m), budget, wanted, bool(m.flag_bits & 1))
                    if budget.left < 0:
                        return
                if len(z.infolist()) > limits.members:
                    yield too_many
        elif ".tar" in lower or lower.endswith((".tgz", ".tbz", ".tbz2", ".txz", ".tzst")) or head[257:262] == b"ustar":
            data.seek(0)  # looking for a zip has moved it
            zst = _zst(data) if lower.endswith((".zst", ".tzst")) else data
            if zst is None:
                yield failure("CAPABILITY", "UNSUPPORTED", "zst needs the zstandard module")
                return
            with tarfile.open(fileobj=zst, mode="r:*" if zst is data else "r|") as t:
                for i, m in enumerate(t, 1):
                    if i > limits.members:
                        yield too_many
                        break
                    kind = "FILE" if m.isreg() else "DIRECTORY" if m.isdir() else "SYMLINK" if m.issym() else "HARDLINK" if m.islnk() else "OTHER"
                    yield _member(i, m.name, kind, m.size, int(m.mtime), lambda m=m: t.extractfile(m), budget, wanted)
                    if budget.left < 0:
                        return
        else:
            single = next((o for end, o in ((".gz", gzip.open), (".bz2", bz2.open), (".xz", lzma.open), (".zst", _zst)) if lower.endswith(end)), None)
            if single is None:
                yield failure("CAPABILITY", "UNSUPPORTED", "no known archive")
            else:
                data.seek(0)
                yield _member(1, name.rpartition("/")[2].rpartition(".")[0], "FILE", None, None, lambda: single(data), budget, wanted)
    except BROKEN as e:
        yield failure("CONTENT", "HEADER", e)


def local(path: str) -> str | None:
    """The name under which this machine opens a path that Spark gives, if it is a file of the shared file system."""
    parsed = urlparse(path)
    return unquote(parsed.path) if parsed.scheme in ("", "file") else None


def listed(spark: SparkSession, paths: list[str] | str, whole: str = "content") -> DataFrame:
    """path, length and, only for files that cannot be opened by name, `whole`."""
    files = spark.read.format("binaryFile").load(paths)
    given = [paths] if isinstance(paths, str) else paths
    near = all(local(p) is not None for p in given) and spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file")
    return files.select("path", "length", (F.lit(None).cast("binary") if near else F.expr(whole)).alias("content"))


def extracted(spark: SparkSession, paths: list[str] | str, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """A row a member, or an error, of every archive at `paths` (anything that Spark reads; files of this file system by seeking)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for path, length, content in zip(batch["path"], batch["length"], batch["content"], strict=True):
                with open(local(path), "rb") if content is None else io.BytesIO(content) as data:
                    held: list[tuple] = []
                    for row, _ in walked(path, data, int(length), limits):
                        held.append((path, *row))
                        if len(held) >= 10_000:
                            yield _frame(held, names)
                            held = []
                    yield _frame(held, names)

    return listed(spark, paths).mapInPandas(run, SCHEMA)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names, dtype=object).astype({c: "Int64" for c in ("ordinal", "declared_size", "actual_size", "modified_sec")})


class Joined(io.RawIOBase):
    """Several files, or other streams of known size, read as one by seeking."""

    def __init__(self, parts: list[str] | list[tuple[BinaryIO, int]]):
        opened = [(open(p, "rb"), os.path.getsize(p)) if isinstance(p, str) else p for p in parts]  # noqa: SIM115
        self.files = [f for f, _ in opened]
        self.ends, total = [], 0
        for _, size in opened:
            total += size
            self.ends.append(total)
        self.total, self.at = total, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, offset + (0, self.at, self.total)[whence])
        return self.at

    def readinto(self, buffer) -> int:
        for i, end in enumerate(self.ends):
            if self.at < end:
                start = self.ends[i - 1] if i else 0
                self.files[i].seek(self.at - start)
                n = self.files[i].readinto(memoryview(buffer)[: end - self.at])
                self.at += n
                return n
        return 0

    def close(self) -> None:
        for f in self.files:
            f.close()
        super().close()

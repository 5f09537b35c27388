"""Headers of disk images: format, size, what they are built on, and whether they are encrypted.

Providers that read inside images need tools that are not here; `Provider` is what such a
one implements, and `Fixture` serves prepared rows through it.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tallyvault.sources.archive_files import listed, local

HEAD = 1 << 16
SCHEMA = "path string, format string, virtual_size long, backing string, extents array<string>, encrypted boolean, error string"
# fixed values: first bytes of each format
QCOW, QED, VHDX, VMDK, VPC = b"QFI\xfb", b"QED\0", b"vhdxfile", b"KDMV", b"conectix"
VDI_MARK = 0xBEDA107F


class Provider(Protocol):
    """Says what is inside an image, given by its path: the rows of a table, without their result_id."""

    def rows(self, table: str, image: str) -> list[dict]: ...


@dataclass
class Fixture:
    tables: dict[str, list[dict]] = field(default_factory=dict)

    def rows(self, table: str, image: str) -> list[dict]:
        return [r for r in self.tables.get(table, []) if r["image"] == image]


def described(head: bytes, tail: bytes = b"") -> dict:
    """What the first bytes of an image (and for vpc the last 512) say of it."""
    out = {"format": "raw", "virtual_size": None, "backing": None, "extents": [], "encrypted": False, "error": None}

    def text(at: int, n: int) -> str | None:
        return head[at : at + n].decode("utf-8", "replace") if n and at + n <= len(head) else None

    try:
        if head[:4] == QCOW:
            version, at, n, _, size = struct.unpack(">IQIIQ", head[4:32])
            crypt = struct.unpack(">I", head[32:36])[0] if version >= 2 else struct.unpack(">I", head[36:40])[0]
            return out | {"format": "qcow" if version == 1 else "qcow2", "virtual_size": size, "backing": text(at, n) if at else None, "encrypted": crypt != 0}
        if head[:4] == QED:
            flags = struct.unpack("<Q", head[16:24])[0]
            size, at, n = struct.unpack("<QII", head[48:64])
            return out | {"format": "qed", "virtual_size": size, "backing": text(at, n) if flags & 1 else None}
        if head[:8] == VHDX:
            return out | {"format": "vhdx"}
        if head[64:68] == struct.pack("<I", VDI_MARK):
            kind, size = struct.unpack("<I", head[76:80])[0], struct.unpack("<Q", head[368:376])[0]
            return out | {"format": "vdi", "virtual_size": size, "error": "UNSUPPORTED_DIFFERENCE" if kind == 4 else None}
        if head[:4] == VMDK:
            sectors, at, n = struct.unpack("<Q", head[12:20])[0], *struct.unpack("<QQ", head[28:44])
            return _descriptor(head[at * 512 : (at + n) * 512].rstrip(b"\0"), out | {"virtual_size": sectors * 512}) if at else out | {"format": "vmdk", "virtual_size": sectors * 512}
        if head.lstrip()[:21] == b"# Disk DescriptorFile":
            return _descriptor(head, out)
        if VPC in (head[:8], tail[:8]):
            footer = head if head[:8] == VPC else tail
            size, kind = struct.unpack(">Q", footer[48:56])[0], struct.unpack(">I", footer[60:64])[0]
            return out | {"format": "vpc", "virtual_size": size, "error": "UNSUPPORTED_DIFFERENCE" if kind == 4 else None}
    except struct.error:
        return out | {"error": "TRUNCATED_HEADER"}
    return out


def _descriptor(body: bytes, out: dict) -> dict:
    text = body.decode("utf-8", "replace")
    parent = re.search(r'^parentFileNameHint\s*=\s*"([^"]*)"', text, re.MULTILINE)
    extents = re.findall(r'^(?:RW|RDONLY)\s+(\d+)\s+\w+(?:\s+"([^"]*)")?', text, re.MULTILINE)
    total = sum(int(n) for n, _ in extents) * 512
    return out | {"format": "vmdk", "virtual_size": out["virtual_size"] or total, "backing": parent[1] if parent else None, "extents": [f for _, f in extents if f], "encrypted": bool(re.search(r"^encryption\.", text, re.MULTILINE))}


def read_ends(path: str, length: int) -> tuple[bytes, bytes]:
    """The first and the last bytes of a file of this file system."""
    with open(path, "rb") as f:
        head = f.read(HEAD)
        f.seek(max(0, length - 512))
        return head, f.read(512)


def headers(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """A row for each image at `paths`; only the ends of a file are read, of files of this file system by seeking."""

    def ends(path: str, length: int, content: bytes | None) -> tuple[bytes, bytes]:
        if content is not None:
            return content[:HEAD], content[-512:]
        return read_ends(local(path), length)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([{"path": p} | described(*ends(p, int(n), None if c is None else bytes(c))) for p, n, c in zip(batch["path"], batch["length"], batch["content"], strict=True)])
            yield out.astype({"virtual_size": "Int64"})

    whole = f"concat(substring(content, 1, {HEAD}), substring(content, greatest({HEAD} + 1, length(content) - 511), 512))"
    return listed(spark, paths, whole).mapInPandas(run, SCHEMA)

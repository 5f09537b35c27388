"""Portable stored paths as column expressions: text with an identity, whatever host reads it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DRIVE, UNC, POSIX, UNKNOWN = "WINDOWS_DRIVE", "WINDOWS_UNC", "POSIX", "UNKNOWN"
#: Names that Windows keeps for devices.
DEVICES = ["CON", "PRN", "AUX", "NUL", *(f"{d}{n}" for d in ("COM", "LPT") for n in "123456789¹²³")]
_DEVICE = rf"(?i)\A(?:{'|'.join(DEVICES)})(?:\.(?s:.*))?\z"
_BAD_WINDOWS = r'[\\<>:"|?*\x00-\x1f]|[ .]\z'


def windows(root: Column) -> Column:
    """Whether the root is of a Windows style, so that names under it have no case."""
    return root.rlike(r"\A[A-Za-z]:/") | root.startswith("//")


def _sound(tail: Column, on_windows: Column) -> Column:
    """Whether every component may be stored; an empty tail may."""
    parts = F.split(tail, "/", -1)
    plain = ~F.exists(parts, lambda p: (p == "") | (p == ".") | (p == "..") | p.contains("\0"))
    special = F.exists(parts, lambda p: p.rlike(_BAD_WINDOWS) | p.rlike(_DEVICE))
    return (tail == "") | (plain & ~(on_windows & special))


def style(root: Column) -> Column:
    """WINDOWS_DRIVE, WINDOWS_UNC or POSIX; UNKNOWN for a root that cannot be stored (null too)."""
    drive, unc = root.rlike(r"\A[A-Za-z]:/"), root.startswith("//")
    tail = F.when(drive, F.substring(root, 4, 1 << 30)).when(unc, F.substring(root, 3, 1 << 30)).otherwise(F.substring(root, 2, 1 << 30))
    kind = F.when(drive, DRIVE).when(unc & root.rlike(r"\A//[^/]+/[^/]+"), UNC).when(~unc & root.startswith("/"), POSIX)
    return F.when(_sound(tail, drive | unc), F.coalesce(kind, F.lit(UNKNOWN))).otherwise(UNKNOWN)


def valid_relative(root: Column, relative: Column) -> Column:
    return (style(root) != UNKNOWN) & relative.isNotNull() & ~F.coalesce(relative.startswith("/"), F.lit(True)) & _sound(relative, windows(root))


def joined(root: Column, relative: Column) -> Column:
    """The whole path as shown; the root itself for an empty relative path."""
    return F.when(relative == "", root).otherwise(F.concat(root, F.when(root.endswith("/"), "").otherwise("/"), relative))


def recorded(root: Column, relative: Column) -> Column:
    """The whole path as it identifies a recorded file; a separator always stands before the relative path."""
    return F.concat(root, F.when(root.endswith("/"), "").otherwise("/"), relative)


def key(root: Column, path: Column) -> Column:
    """What a path is compared by: in lower case under a Windows root."""
    return F.when(windows(root), F.lower(path)).otherwise(path)


def depth(relative: Column) -> Column:
    return F.length(relative) - F.length(F.replace(relative, F.lit("/"), F.lit("")))


def under(column: Column, path: str | Column) -> Column:
    """The path itself and everything under it; an empty path is everywhere."""
    if isinstance(path, str):
        return F.lit(True) if not path else (column == path) | column.startswith(path + "/")
    return (path == "") | (column == path) | column.startswith(F.concat(path, F.lit("/")))


def encoded_windows(value: str) -> str:
    """A native Windows absolute path in its stored form; for explicit Windows input only."""
    text = value
    if text[:8].lower() == "\\\\?\\unc\\":
        text = "\\\\" + text[8:]
    elif text.startswith("\\\\?\\"):
        text = text[4:]
        if not re.match(r"[A-Za-z]:[\\/]", text):
            raise ValueError("device and volume names cannot be stored")
    if text.startswith("\\\\.\\"):
        raise ValueError("device names cannot be stored")
    text = text.replace("\\", "/")
    if re.match(r"[A-Za-z]:/", text):
        text = text[0].upper() + text[1:]
    elif not re.match(r"//[^/]+/[^/]+", text):
        raise ValueError("a drive or a share is needed")
    return text[:-1] if len(text) > 3 and text.endswith("/") else text


def safe_member(name: Column, most: int = 32_768) -> Column:
    """A member's name within an archive as a relative path, empty and `.` parts left out; null for what could lead outside."""
    parts = F.split(name, "/")
    outside = name.startswith("/") | F.contains(name, F.lit("\\")) | F.contains(name, F.lit("\0")) | name.rlike(r"\A\p{L}:") | (F.octet_length(name) > most) | F.array_contains(parts, "..")
    return F.when(~outside, F.array_join(F.filter(parts, lambda p: ~p.isin("", ".")), "/"))

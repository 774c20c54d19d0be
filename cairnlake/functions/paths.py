"""Listing paths as columns: legality, parents, scopes, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import InvalidPath

MOST_BYTES = 65_535


def path_fault(path: Column) -> Column:
    """Why a listing path is illegal, or null: relative UTF-8 with `/` between segments that are neither empty nor dots."""
    segment = F.split(path, "/", -1)
    return (
        F.when(path.isNull() | (path == ""), "empty")
        .when(F.octet_length(path) > MOST_BYTES, "too long")
        .when(path.contains("\0"), "nul")
        .when(path.contains("\\"), "backslash")
        .when(path.startswith("/"), "absolute")
        .when(path.rlike("^[A-Za-z]:"), "drive letter")
        .when(F.exists(segment, lambda s: s == ""), "empty segment")
        .when(F.exists(segment, lambda s: s.isin(".", "..")), "dot segment")
    )


def is_legal(path: Column) -> Column:
    return path_fault(path).isNull()


def check_path(path: str) -> str:
    """The path itself; InvalidPath if it is illegal."""
    parts = path.split("/")
    if not path or len(path.encode()) > MOST_BYTES or "\0" in path or "\\" in path or path[0] == "/" or (len(path) > 1 and path[1] == ":" and path[0].isascii() and path[0].isalpha()) or {"", ".", ".."} & set(parts):
        raise InvalidPath(repr(path))
    return path


def parent(path: Column) -> Column:
    """The path without its last segment; empty for the root's children."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ancestors(path: Column) -> Column:
    """All proper ancestors, the shortest first."""
    parts = F.split(path, "/", -1)
    return F.transform(F.slice(F.sequence(F.lit(0), F.size(parts) - 1), 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def lookup_path(path: str) -> str:
    """A path as a user gives it to `cat`: leading `./` are dropped, then it must be legal."""
    while path.startswith("./"):
        path = path[2:]
    return check_path(path)


def blob_name(path: Column) -> Column:
    """The name of a single-blob listing's file: its own without the extension."""
    return F.regexp_replace(base_name(path), "[.]cfidx$", "")

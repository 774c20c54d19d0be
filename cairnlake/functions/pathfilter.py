"""Path scopes, compiled to one boolean column that reaches the Parquet scan as equality and prefix filters.

Includes: a path is in scope if it equals one, or lies below it; no includes mean all. Excludes, after includes: `dir/` takes a
subtree, one `*` at the end a prefix, at the start a suffix, anything else a whole path; a `*` elsewhere is an error.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import InvalidPattern


def exclude_column(pattern: str, path: Column) -> Column:
    stars = pattern.count("*")
    if pattern in ("", "/") or stars > 1 or (stars and pattern[0] != "*" and pattern[-1] != "*"):
        raise InvalidPattern(f"exclude pattern {pattern!r}")
    if stars and pattern.endswith("/"):
        raise InvalidPattern(f"exclude pattern {pattern!r}")
    if pattern == "*":
        return F.lit(True)
    if pattern.endswith("/"):
        return (path == pattern[:-1]) | path.startswith(pattern)
    if pattern.endswith("*"):
        return path.startswith(pattern[:-1])
    if pattern.startswith("*"):
        return path.endswith(pattern[1:])
    return path == pattern


@dataclasses.dataclass(frozen=True)
class PathFilter:
    includes: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for p in self.excludes:  # grammar errors show when the filter is made
            if p in ("", "/") or p.count("*") > 1 or ("*" in p and not (p[0] == "*" or p[-1] == "*")) or (p[:1] == "*" and p != "*" and p.endswith("/")):
                raise InvalidPattern(f"exclude pattern {p!r}")

    @property
    def empty(self) -> bool:
        return not self.includes and not self.excludes

    def allows(self, path: Column) -> Column:
        either = lambda cs: functools.reduce(lambda a, b: a | b, cs)
        inside = either([(path == p) | path.startswith(p + "/") for p in self.includes]) if self.includes else F.lit(True)
        return inside & ~either([exclude_column(p, path) for p in self.excludes]) if self.excludes else inside


def from_lines(text: str) -> list[str]:
    """Patterns of a list file: trimmed; blank lines and those that start with `#` are skipped."""
    return [s for line in text.split("\n") if (s := line.strip()) and not s.startswith("#")]


def read_list(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return from_lines(f.read())


def scope(includes: Iterable[str] = (), excludes: Iterable[str] = (), include_files: Iterable[str] = (), exclude_files: Iterable[str] = ()) -> PathFilter:
    """Flags and list files together, in order."""
    return PathFilter((*includes, *(p for f in include_files for p in read_list(f))), (*excludes, *(p for f in exclude_files for p in read_list(f))))

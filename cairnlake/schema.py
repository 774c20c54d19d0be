"""Schemas of the canonical tables, chunk parameters and errors."""

from __future__ import annotations

import dataclasses

from pyspark.sql import types as T


class CairnError(Exception):
    """Base of all errors of this library."""


class BadMagic(CairnError):
    pass


class UnsupportedMajor(CairnError):
    pass


class UnsupportedFormatVersion(CairnError):
    pass


class Truncated(CairnError):
    pass


class TrailerMismatch(CairnError):
    pass


class InvalidStructure(CairnError):
    pass


class InvalidPath(CairnError):
    pass


class InvalidPattern(CairnError, ValueError):
    pass


class StoreError(CairnError):
    pass


class ChunkNotFound(StoreError):
    pass


class ChunkCorrupt(StoreError):
    pass


class IdMismatch(StoreError):
    pass


@dataclasses.dataclass(frozen=True)
class ChunkParams:
    """Least, average and greatest chunk length in bytes: positive, even, in this order."""

    min: int = 16 << 10
    avg: int = 64 << 10
    max: int = 256 << 10

    def __post_init__(self) -> None:
        for name in ("min", "avg", "max"):
            v = getattr(self, name)
            if v <= 0 or v % 2:
                raise ValueError(f"chunk size {name} must be positive and even, not {v}")
        if not self.min <= self.avg <= self.max:
            raise ValueError(f"chunk sizes must ascend: {self.min}:{self.avg}:{self.max}")

    @classmethod
    def parse(cls, text: str) -> ChunkParams:
        """`min:avg:max`, three decimal integers."""
        parts = text.split(":")
        if len(parts) != 3 or not all(p.strip().isdigit() for p in parts):
            raise ValueError(f"expected min:avg:max, not {text!r}")
        return cls(*(int(p) for p in parts))


CHUNKS = T.ArrayType(T.StructType([T.StructField("end_offset", T.LongType()), T.StructField("chunk_id", T.StringType())]))
BLOBS = T.StructType([T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("mode", T.LongType()), T.StructField("size", T.LongType()), T.StructField("mtime_secs", T.LongType()), T.StructField("target", T.StringType()), T.StructField("content", T.BinaryType())])
#: A listing: one row per path; blob_id and chunks of files only, target of symlinks only. Ids are 64 lower-case hexadecimal digits.
ENTRIES = T.StructType([T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("mode", T.LongType()), T.StructField("size", T.LongType()), T.StructField("mtime_secs", T.LongType()), T.StructField("blob_id", T.StringType()), T.StructField("target", T.StringType()), T.StructField("chunks", CHUNKS)])
STORE = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("len_plain", T.LongType()), T.StructField("len_disk", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("prefix", T.StringType())])

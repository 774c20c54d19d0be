"""Chunk and blob ids as columns: lower-case hexadecimal SHA-256 (built in) or BLAKE3 (Arrow UDF)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALGORITHMS = ("sha256", "blake3")
_BATCH = 4 << 20


@F.arrow_udf(T.StringType())
def blake3_hex(payload: pa.Array) -> pa.Array:
    from . import blake3

    out: list[str | None] = []
    held: list[bytes | None] = []
    size = 0

    def flush() -> None:
        got = iter(blake3.digests([x for x in held if x is not None]))
        out.extend(None if x is None else next(got).hex() for x in held)
        held.clear()

    for x in payload:
        held.append(x.as_py())
        size += len(held[-1] or b"")
        if size >= _BATCH:
            flush()
            size = 0
    flush()
    return pa.array(out, pa.string())


def content_id(payload: Column, algorithm: str = "sha256") -> Column:
    """The id of a binary column; null stays null."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"hash algorithm {algorithm!r}: expected one of {', '.join(ALGORITHMS)}")
    return F.sha2(payload, 256) if algorithm == "sha256" else blake3_hex(payload)


def is_id(text: Column) -> Column:
    """Exactly 64 lower-case hexadecimal digits."""
    return F.coalesce(text.rlike("^[0-9a-f]{64}\\z"), F.lit(False))


def parse_id(text: str) -> bytes:
    if len(text) != 64 or text.strip("0123456789abcdef"):
        raise ValueError(f"not a chunk id: {text!r}")
    return bytes.fromhex(text)


def prefix(chunk_id: Column) -> Column:
    """The two digits by which store tables are partitioned."""
    return F.substring(chunk_id, 1, 2)


def hasher(algorithm: str = "sha256"):
    """An object with update(bytes) and hexdigest(), whose memory doesn't grow with the input."""
    if algorithm == "blake3":
        from . import blake3

        return blake3.Hasher()
    import hashlib

    return hashlib.sha256()


def hash_streams(chunks: Iterator[bytes], algorithm: str = "sha256") -> str:
    """The id of bytes that come in pieces."""
    h = hasher(algorithm)
    for c in chunks:
        h.update(c)
    return h.hexdigest()

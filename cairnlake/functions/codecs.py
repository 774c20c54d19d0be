"""Payload codecs of stores: none, or zstd through an Arrow UDF (level 3)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVEL = 3
CODECS = ("none", "zstd")


def parse_compression(text: str, ignore_case: bool = True) -> str:
    name = text.lower() if ignore_case else text
    if name not in CODECS:
        raise ValueError(f"compression {text!r}: expected none or zstd")
    return name


@F.arrow_udf(T.BinaryType())
def zstd_encode(payload: pa.Array) -> pa.Array:
    import zstandard

    c = zstandard.ZstdCompressor(level=LEVEL)
    return pa.array((None if x.as_buffer() is None else c.compress(x.as_buffer()) for x in payload), pa.binary())


@F.arrow_udf(T.BinaryType())
def zstd_decode(payload: pa.Array) -> pa.Array:
    """Null where a frame can't be decoded."""
    import zstandard

    d = zstandard.ZstdDecompressor()

    def one(x: pa.Buffer | None) -> bytes | None:
        try:
            return None if x is None else d.decompressobj().decompress(x)
        except zstandard.ZstdError:
            return None

    return pa.array((one(x.as_buffer()) for x in payload), pa.binary())


def encoded(payload: Column, compression: str) -> Column:
    return zstd_encode(payload) if compression == "zstd" else payload


def decoded(payload: Column, compression: str) -> Column:
    return zstd_decode(payload) if compression == "zstd" else payload

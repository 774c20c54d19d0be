"""Chunk tables of blobs: fixed-size chunks in plain SQL, content-defined ones by an Arrow UDF, without a shuffle."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import blake3, cdc
from ..functions.batches import bounded
from ..functions.hashing import content_id
from ..schema import ChunkParams

_ARRAY = "array<struct<end_offset:long,chunk_id:string>>"
_ARROW = pa.list_(pa.struct([("end_offset", pa.int64()), ("chunk_id", pa.string())]))


def fixed_chunk_array(content: Column, size: int, algorithm: str = "sha256") -> Column:
    """array<struct<end_offset, chunk_id>> of `size` bytes each (the last may be shorter); empty for an empty blob."""
    n = F.octet_length(content)
    starts = F.sequence(F.lit(0), n - 1, F.lit(size))
    made = F.transform(starts, lambda s: F.struct(F.least(s + size, n).cast("long").alias("end_offset"), F.sha2(F.substring(content, s + 1, F.lit(size)), 256).alias("chunk_id")))
    if algorithm != "sha256":
        return F.when(n > 0, cdc_udf(None, algorithm, size)(content)).otherwise(F.array().cast(_ARRAY))
    return F.when(n > 0, made).otherwise(F.array().cast(_ARRAY))


def cdc_udf(params: ChunkParams | None, algorithm: str = "sha256", fixed: int = 0):
    """Arrow UDF from content to its chunk array; fixed: cut every so many bytes instead."""

    @F.arrow_udf(_ARRAY)
    def chunk(content: pa.Array) -> pa.Array:
        ends: list[list[int] | None] = []
        parts: list[bytes] = []
        ids: list[str] = []

        def flush() -> None:
            ids.extend(d.hex() for d in blake3.digests(parts)) if algorithm == "blake3" else ids.extend(hashlib.sha256(p).hexdigest() for p in parts)
            parts.clear()

        size = 0
        for cell in content:
            x = cell.as_py()
            if x is None:
                ends.append(None)
                continue
            ends.append(cdc.cuts(x, params) if params else [*range(fixed, len(x), fixed), *([len(x)] if x else [])])
            parts += [x[a:b] for a, b in zip([0, *ends[-1]], ends[-1], strict=False)]
            size += len(x)
            if size >= 4 << 20:  # many small chunks are hashed together
                flush()
                size = 0
        flush()
        each = iter(ids)
        return pa.array([e and [{"end_offset": x, "chunk_id": next(each)} for x in e] if e is not None else None for e in ends], _ARROW)

    return chunk


def cdc_chunk_array(content: Column, params: ChunkParams | None = None, algorithm: str = "sha256") -> Column:
    return cdc_udf(params or ChunkParams(), algorithm)(content)


def with_chunks(blobs: DataFrame, size: int | None = None, params: ChunkParams | None = None, algorithm: str = "sha256") -> DataFrame:
    """blobs (path, content, ...) as listing entries: blob_id and chunks in place of content; only files have them."""
    content = F.when(F.col("kind") == "file", F.col("content")) if "kind" in blobs.columns else F.col("content")
    array = fixed_chunk_array(content, size, algorithm) if size else cdc_chunk_array(content, params, algorithm)
    return bounded(blobs).withColumn("blob_id", content_id(content, algorithm)).withColumn("chunks", F.when(content.isNotNull(), array)).drop("content")


def _spans(chunks: Column) -> Column:
    """A chunk array with start_offset and length in each element, so that unfolding it needs nothing but the element."""
    start = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.element_at(chunks, F.greatest(i, F.lit(1)))["end_offset"])
    return F.transform(chunks, lambda c, i: F.struct(start(i).alias("start_offset"), c["end_offset"].alias("end_offset"), (c["end_offset"] - start(i)).alias("length"), c["chunk_id"].alias("chunk_id")))


def chunk_refs(entries: DataFrame, *keys: str) -> DataFrame:
    """One row per chunk reference in listing order, repeats included: keys (path), ord, start_offset, end_offset, length, chunk_id."""
    keys = keys or ("path",)
    at = entries.where("chunks is not null").select(*keys, F.posexplode(_spans(F.col("chunks"))).alias("ord", "c"))
    return at.select(*keys, "ord", "c.start_offset", "c.end_offset", "c.length", "c.chunk_id")


def lengths(refs: DataFrame, *keys: str) -> DataFrame:
    """refs with start_offset and length by difference to the previous end, for chunk tables that hold ends only."""
    w = Window.partitionBy(*(keys or ("path",))).orderBy("ord")
    start = F.lag("end_offset", 1, 0).over(w)
    return refs.withColumn("start_offset", start).withColumn("length", F.col("end_offset") - F.col("start_offset"))


def breaks(refs: DataFrame, *keys: str) -> DataFrame:
    """References that don't begin where the one before them ended."""
    w = Window.partitionBy(*(keys or ("path",))).orderBy("ord")
    return refs.withColumn("expected", F.lag("end_offset", 1, 0).over(w)).where("start_offset <> expected")


def payloads(blobs: DataFrame, entries: DataFrame) -> DataFrame:
    """(chunk_id, payload) of every reference; blobs and entries share path."""
    refs = chunk_refs(entries)
    return refs.join(blobs.select("path", "content"), "path").select("chunk_id", F.expr("substring(content, cast(start_offset + 1 as int), cast(length as int))").alias("payload"))


def blob_payloads(blobs: DataFrame, size: int | None = None, params: ChunkParams | None = None, algorithm: str = "sha256") -> DataFrame:
    """(chunk_id, payload) of every chunk of blobs, cut where they lie: no join, no shuffle."""
    files = blobs.where(F.octet_length("content") > 0) if "kind" not in blobs.columns else blobs.where((F.col("kind") == "file") & (F.octet_length("content") > 0))
    array = fixed_chunk_array(F.col("content"), size, algorithm) if size else cdc_chunk_array(F.col("content"), params, algorithm)
    cut = F.transform(_spans(F.col("chunks")), lambda c: F.struct(c["chunk_id"].alias("chunk_id"), F.substring(F.col("content"), (c["start_offset"] + 1).cast("int"), c["length"].cast("int")).alias("payload")))
    return bounded(files).select("content", array.alias("chunks")).select(F.explode(cut).alias("c")).select("c.*")


def dedup_counters(refs: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row: chunks, new, reused, bytes, unique_bytes, saved_bytes. stored: chunk_id of what a store already has.

    References are summed up by id before anything is joined, so a chunk that all files share costs a row per task."""
    ids = refs.groupBy("chunk_id").agg(F.count("*").alias("n"), F.max("length").alias("length"))
    if stored is not None:
        ids = ids.join(stored.select("chunk_id", F.lit(True).alias("has")), "chunk_id", "left")
    else:
        ids = ids.withColumn("has", F.lit(None).cast("boolean"))
    fresh = F.col("has").isNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    total = ids.agg(zero(F.sum("n")).alias("chunks"), F.count(F.when(fresh, 1)).alias("new"), zero(F.sum(F.col("n") * F.col("length"))).alias("bytes"), zero(F.sum(F.when(fresh, F.col("length")))).alias("unique_bytes"))
    return total.select("chunks", "new", (F.col("chunks") - F.col("new")).alias("reused"), "bytes", "unique_bytes", (F.col("bytes") - F.col("unique_bytes")).alias("saved_bytes"))


def register(spark: SparkSession) -> None:
    """SQL functions blake3, zstd_encode, zstd_decode and the table function cdc_chunks(content, min, avg, max)."""
    from pyspark.sql.functions import udtf

    from ..functions.codecs import zstd_decode, zstd_encode
    from ..functions.hashing import blake3_hex

    @udtf(returnType="ord int, start_offset long, length long, chunk_id string")
    class CdcChunks:
        def eval(self, content: bytes, least: int, average: int, most: int):
            start = 0
            for k, end in enumerate(cdc.cuts(content or b"", ChunkParams(least, average, most))):
                yield k, start, end - start, blake3.digest(bytes(content[start:end])).hex()
                start = end

    spark.udf.register("blake3", blake3_hex)
    spark.udf.register("zstd_encode", zstd_encode)
    spark.udf.register("zstd_decode", zstd_decode)
    spark.udtf.register("cdc_chunks", CdcChunks)

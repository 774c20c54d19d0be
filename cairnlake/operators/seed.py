"""Reuse of earlier listings: decisions, plans and verified reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import content_id
from ..functions.paths import ancestors, is_legal
from .chunking import chunk_refs


def decisions(source: DataFrame, prior: DataFrame, trust_mtime: bool = False) -> DataFrame:
    """(path, decision: reuse or rechunk) of source files against a prior listing.

    A path or size that is new decides without content, as does an equal mtime if it is trusted; blob_id of source may be
    null where nothing was hashed, which rechunks."""
    old = prior.where("kind = 'file'").select("path", F.struct("size", "mtime_secs", "blob_id").alias("p"))
    at = source.where("kind = 'file'").join(old, "path", "left")
    decision = F.when(F.col("p").isNull() | (F.col("p.size") != F.col("size")), "rechunk").when(F.lit(trust_mtime) & (F.col("p.mtime_secs") == F.col("mtime_secs")), "reuse").when(F.col("p.blob_id") == F.col("blob_id"), "reuse").otherwise("rechunk")
    return at.select("path", decision.alias("decision"))


def needs_hash(source: DataFrame, prior: DataFrame, trust_mtime: bool = False) -> DataFrame:
    """Source files whose content must be read to decide: known path, equal size, and no trusted mtime. Hash these alone and union the others back."""
    old = prior.where("kind = 'file'").select("path", F.col("size").alias("old_size"), F.col("mtime_secs").alias("old_mtime"))
    at = source.where("kind = 'file'").join(old, "path").where("size = old_size")
    return (at.where("mtime_secs <> old_mtime") if trust_mtime else at).drop("old_size", "old_mtime")


def reusable(decided: DataFrame, prior: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, decision, seed_missing) after a check that all chunks of a reused file are stored; else it is rechunked."""
    refs = chunk_refs(prior.where("kind = 'file'").join(decided.where("decision = 'reuse'").select("path"), "path", "left_semi"))
    lacking = refs.join(stored.select("chunk_id"), "chunk_id", "left_anti").select("path").distinct().withColumn("lacks", F.lit(True))
    at = decided.join(lacking, "path", "left")
    return at.select("path", F.when(F.col("lacks"), "rechunk").otherwise(F.col("decision")).alias("decision"), F.coalesce("lacks", F.lit(False)).alias("seed_missing"))


def seed_plan(listing: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(chunk_id, path, ord, offset, length): where each chunk lies in the tree that a listing describes.

    Files with illegal paths or chunk tables that don't ascend are left out; wanted (chunk_id) narrows before the join."""
    ends = F.transform("chunks", lambda c: c["end_offset"])
    n = F.size("chunks")
    rises = F.coalesce(F.forall(F.arrays_zip(F.concat(F.array(F.lit(0).cast("long")), F.slice(ends, 1, n - 1)).alias("a"), ends.alias("b")), lambda p: p["b"] > p["a"]), F.lit(True))
    good = listing.where((F.col("kind") == "file") & is_legal(F.col("path")) & (n > 0)).where(rises)
    refs = chunk_refs(good).select("chunk_id", "path", "ord", F.col("start_offset").alias("offset"), "length")
    return refs.join(wanted.select("chunk_id").distinct(), "chunk_id", "left_semi") if wanted is not None else refs


def seed_reads(plan: DataFrame, blobs: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """(chunk_id, path, offset, payload) of the first place, by path and offset, whose bytes still hash to the id; each candidate is read and checked.

    blobs: path, content, and kind where it may hold symlinks: a file below one is never read. Short reads and changed bytes are stale
    and make way for the next place. Places are checked and chosen where the files are; only the bytes of the chosen ones are moved."""
    if "kind" in blobs.columns:
        links = blobs.where("kind = 'symlink'").select(F.col("path").alias("link"))
        files = plan.select("path").distinct()
        below = files.select("path", F.explode(F.array_append(ancestors(F.col("path")), F.col("path"))).alias("link")).join(links, "link", "left_semi").select("path").distinct()
        plan, blobs = plan.join(below, "path", "left_anti"), blobs.where("kind = 'file'")
    content = blobs.select("path", "content")
    part = F.expr("substring(content, cast(offset + 1 as int), cast(length as int))")
    cut = plan.join(content, "path").select("chunk_id", "path", "offset", "length", part.alias("payload"))
    good = cut.where((F.octet_length("payload") == F.col("length")) & (content_id(F.col("payload"), algorithm) == F.col("chunk_id")))
    chosen = good.groupBy("chunk_id").agg(F.min(F.struct("path", "offset", "length")).alias("x")).select("chunk_id", "x.*")
    return chosen.join(content, "path").select("chunk_id", "path", "offset", part.alias("payload"))


def seed_stats(wanted: DataFrame, plan: DataFrame, reads: DataFrame) -> DataFrame:
    """One row over distinct wanted ids: hits, stale (planned, but no place is valid), misses (not planned), bytes read."""
    ids = wanted.select("chunk_id").distinct()
    at = ids.join(plan.select("chunk_id").distinct().withColumn("planned", F.lit(True)), "chunk_id", "left").join(reads.select("chunk_id", F.octet_length("payload").cast("long").alias("bytes")), "chunk_id", "left")
    return at.agg(F.count("bytes").alias("hits"), F.count(F.when(F.col("planned") & F.col("bytes").isNull(), 1)).alias("stale"), F.count(F.when(F.col("planned").isNull(), 1)).alias("misses"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))

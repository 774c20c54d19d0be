"""Differences of two listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import chunk_refs
from .listing import LEAVES

CATEGORIES = ("added", "removed", "changed", "meta_changed", "same")


def diff_paths(left: DataFrame, right: DataFrame) -> DataFrame:
    """(path, category) over the files and symlinks of both; directories don't count.

    Files differ by blob or size (changed), then mode or mtime (meta_changed); symlinks by target, then mode; kinds by being
    different (changed). Chunk tables aren't read."""
    columns = ["kind", "mode", "size", "mtime_secs", "blob_id", "target"]
    side = lambda df, s: df.where(F.col("kind").isin(*LEAVES)).select("path", F.struct(*columns).alias(s))
    both = side(left, "l").join(side(right, "r"), "path", "full_outer")
    same = lambda *cs: F.array(*[F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in cs])
    all_ = lambda *cs: F.forall(same(*cs), lambda x: x)
    file = F.col("l.kind") == "file"
    category = (
        F.when(F.col("l").isNull(), "added")
        .when(F.col("r").isNull(), "removed")
        .when(F.col("l.kind") != F.col("r.kind"), "changed")
        .when(file & ~all_("blob_id", "size"), "changed")
        .when(file & ~all_("mode", "mtime_secs"), "meta_changed")
        .when(~file & ~all_("target"), "changed")
        .when(~file & ~all_("mode"), "meta_changed")
        .otherwise("same")
    )
    return both.select("path", category.alias("category"))


def chunk_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: chunks_shared, chunks_only_left, chunks_only_right, over distinct ids; one shuffle, both sides marked and summed up by id."""
    marked = chunk_refs(left).select("chunk_id", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(chunk_refs(right).select("chunk_id", F.lit(0).alias("l"), F.lit(1).alias("r")))
    ids = marked.groupBy("chunk_id").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return ids.agg(F.count(F.when((F.col("l") == 1) & (F.col("r") == 1), 1)).alias("chunks_shared"), F.count(F.when(F.col("r") == 0, 1)).alias("chunks_only_left"), F.count(F.when(F.col("l") == 0, 1)).alias("chunks_only_right"))


def summary(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: counts of all categories and of chunks, and whether anything differs."""
    counts = diff_paths(left, right).agg(*[F.count(F.when(F.col("category") == c, 1)).alias(c) for c in CATEGORIES])
    row = counts.crossJoin(F.broadcast(chunk_overlap(left, right)))  # one row each
    differs = F.lit(0)
    for c in ("added", "removed", "changed", "meta_changed", "chunks_only_left", "chunks_only_right"):
        differs = differs + F.col(c)
    return row.withColumn("differs", differs > 0)


def tree_as_listing(tree: DataFrame, listing: DataFrame) -> DataFrame:
    """The left side of a diff of a live tree with a listing: files of equal content take the listing's entry, so mode and mtime
    never count; others keep their own and have no chunks."""
    old = listing.where("kind = 'file'").select("path", F.col("blob_id").alias("old_blob"), F.struct("mode", "mtime_secs", "chunks").alias("old"))
    at = tree.join(old, "path", "left")
    equal = (F.col("kind") == "file") & F.col("blob_id").eqNullSafe(F.col("old_blob")) & F.col("old").isNotNull()
    take = lambda c, own: F.when(equal, F.col(f"old.{c}")).otherwise(own).alias(c)
    return at.select("path", "kind", take("mode", F.col("mode")), "size", take("mtime_secs", F.col("mtime_secs")), "blob_id", "target", take("chunks", F.lit(None).cast("array<struct<end_offset:long,chunk_id:string>>")))

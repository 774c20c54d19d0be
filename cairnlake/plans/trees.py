"""Trees and listings made from the driver's documents: each document is a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import bounded
from ..operators.chunking import chunk_refs, with_chunks

CHUNK = 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text"))


def blobs(docs: DataFrame) -> DataFrame:
    """path, kind, mode, size, mtime_secs, target, content, and doc_id."""
    content = F.encode("text", "utf-8")
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    return docs.select("doc_id", path.alias("path"), F.lit("file").alias("kind"), F.lit(420).cast("long").alias("mode"), F.octet_length(content).cast("long").alias("size"), (F.col("doc_id") + 1_700_000_000).alias("mtime_secs"), F.lit(None).cast("string").alias("target"), content.alias("content"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs(documents(spark, sf_dir))


def v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs(documents(spark, sf_dir).where("doc_id % 11 <> 0"))


def v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree a while later: files gone and new, some changed, some touched."""
    docs = documents(spark, sf_dir).where("doc_id % 13 <> 0")
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" v2"))).otherwise(F.col("text")))
    return blobs(changed).withColumn("mtime_secs", F.col("mtime_secs") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0))


def listing(tree_: DataFrame) -> DataFrame:
    return with_chunks(tree_, CHUNK)


def with_links(entries: DataFrame) -> DataFrame:
    """entries plus a symlink per file whose id is divisible by 50, plus explicit directories of each source and of `empty`."""
    links = entries.where("doc_id % 50 = 0").select("doc_id", F.concat(F.lit("links/"), F.col("doc_id"), F.lit(".lnk")).alias("path"), F.lit("symlink").alias("kind"), F.lit(511).cast("long").alias("mode"), F.concat(F.lit("../"), F.col("path")).alias("target"))
    tops = entries.select(F.substring_index("path", "/", 1).alias("path")).distinct()
    some = entries.sparkSession.sql("select 'empty' as path union all select 'links'")
    dirs = tops.unionByName(some).select("path", F.lit("dir").alias("kind"), F.lit(493).cast("long").alias("mode"))
    return entries.unionByName(links, allowMissingColumns=True).unionByName(dirs, allowMissingColumns=True)


def store(tree_: DataFrame) -> DataFrame:
    """The distinct chunks of a tree: chunk_id, length; the payload stays out of whatever doesn't ask for it."""
    return chunk_refs(listing(tree_)).groupBy("chunk_id").agg(F.max("length").alias("length"))


def holes(stored: DataFrame) -> DataFrame:
    """A store that lacks the ids from f0 on."""
    return stored.where(F.col("chunk_id") < "f0")

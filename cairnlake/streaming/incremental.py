"""Incremental archiving, an extension: files that appear in a folder are cut and stored micro-batch by micro-batch.

Chunks are addressed by content, so a batch that runs again after a failure adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import blob_payloads, with_chunks
from ..operators.store import Store
from ..schema import ChunkParams


def watch(spark: SparkSession, folder: str, store: Store, entries_path: str, checkpoint: str, params: ChunkParams | None = None, fixed: int | None = None, files_per_trigger: int = 1000) -> StreamingQuery:
    """Processes what is there and stops; entries of new files are appended, partitioned by batch, to the Parquet table at entries_path."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").load(folder)
    blobs = found.select(F.col("path"), F.lit("file").alias("kind"), F.lit(0o644).cast("long").alias("mode"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime_secs"), F.lit(None).cast("string").alias("target"), "content")

    def batch(df: DataFrame, number: int) -> None:
        store.put(blob_payloads(df, fixed, params, store.algorithm), verify=False, counted=False)
        with_chunks(df, fixed, params, store.algorithm).write.mode("overwrite").parquet(f"{entries_path}/batch={number}")

    return blobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

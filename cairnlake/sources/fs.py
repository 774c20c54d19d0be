"""Small files on whatever file system Spark reaches, through Hadoop's API (store metadata and manifests)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir, or where it is unset in local mode a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", "")
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="cairnlake-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        shared = "file://" + _OWN[0]
    return f"{shared.rstrip('/')}/s-{uuid.uuid4().hex}"


def kept(df):
    """df as a table in the shared scratch folder: what it asked of others is asked once, whatever reads it and whoever dies."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def read(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """The whole file appears at once: written beside, then renamed."""
    fs, p = _at(spark, path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + ".part")
    stream = fs.create(part, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    if overwrite and fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"can't write {path}")


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)

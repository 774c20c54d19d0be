"""Arrow batches between Spark and its Python workers."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of an Arrow batch between Spark and a worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """df; from now on Arrow batches of its session hold at most about BATCH_BYTES, however long texts are."""
    conf = df.sparkSession.conf
    now = conf.get(_BATCH).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df

"""Moving chunks between stores: outcomes, origins in order, read-through caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: HTTP statuses that may pass: fixed values.
TRANSIENT = [408, 429, 500, 501, 502, 503, 504, 520, 521, 522, 523, 524]
MISSING = [404, 410]


def status_class(code: Column, corrupt: Column | None = None) -> Column:
    """missing, transient, permanent or corrupt; null for a success."""
    plain = F.when(code.between(200, 299), None).when(code.isin(MISSING), "missing").when(code.isin(TRANSIENT), "transient").otherwise("permanent")
    return plain if corrupt is None else F.when(corrupt, "corrupt").otherwise(plain)


def status_of_message(message: Column) -> Column:
    """The status that an error text names (`HTTP 503`), as int; null if none."""
    code = F.regexp_extract(message, "HTTP ([0-9]{3})\\b", 1)
    return F.when(code != "", code).cast("int")


def bucket(cls: Column) -> Column:
    return F.when(cls == "transient", "failed_transient").otherwise("failed_permanent")


def push_outcomes(refs: DataFrame, local: DataFrame, remote: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """(chunk_id, outcome) of each distinct reference: failed_permanent if it isn't local, whatever the remote has; skipped if the
    remote has it; else uploaded, or the bucket of its failure. failures: chunk_id, error_class."""
    return _outcomes(refs, F.when(F.col("here").isNull(), "failed_permanent").when(F.col("there").isNotNull(), "skipped"), "uploaded", local, remote, failures)


def pull_outcomes(refs: DataFrame, local: DataFrame, remote: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """(chunk_id, outcome) of each distinct reference: skipped if it is local; failed_permanent if the remote lacks it; else fetched, or the bucket of its failure."""
    return _outcomes(refs, F.when(F.col("here").isNotNull(), "skipped").when(F.col("there").isNull(), "failed_permanent"), "fetched", local, remote, failures)


def _outcomes(refs, early, done, local, remote, failures):
    at = refs.select("chunk_id").distinct()
    at = at.join(local.select("chunk_id", F.lit(True).alias("here")), "chunk_id", "left").join(remote.select("chunk_id", F.lit(True).alias("there")), "chunk_id", "left")
    failed = F.lit(None).cast("string")
    if failures is not None:
        at = at.join(failures.select("chunk_id", "error_class"), "chunk_id", "left")
        failed = F.when(F.col("error_class").isNotNull(), bucket(F.col("error_class")))
    return at.select("chunk_id", F.coalesce(early, failed, F.lit(done)).alias("outcome"))


def outcome_report(outcomes: DataFrame, done: str, listings: int, dry_run: bool = False) -> DataFrame:
    """One row with the stable fields: skipped, uploaded or fetched, failed (and by bucket), unique_chunks, listings, dry_run, ok."""
    n = lambda s: F.count(F.when(F.col("outcome") == s, 1))
    out = outcomes.agg(n("skipped").alias("skipped"), n(done).alias(done), n("failed_transient").alias("failed_transient"), n("failed_permanent").alias("failed_permanent"), F.count("*").alias("unique_chunks"))
    out = out.withColumn("failed", F.col("failed_transient") + F.col("failed_permanent"))
    return out.withColumn("listings", F.lit(listings).cast("long")).withColumn("dry_run", F.lit(dry_run)).withColumn("ok", F.col("failed") == 0)


def fallback(sources: list[DataFrame], wanted: DataFrame | None = None) -> DataFrame:
    """(chunk_id, origin, payload) from the first source that has the id; sources: chunk_id, payload, in order. Only absence moves on.

    Each source after the first is asked only for what the ones before it lack, so no payload is moved to be thrown away."""
    out, left = None, wanted.select("chunk_id").distinct() if wanted is not None else None
    for k, s in enumerate(sources):
        rows = s.select("chunk_id", F.lit(k).alias("origin"), "payload")
        if left is not None:
            rows = rows.join(left, "chunk_id", "left_semi")
            left = left.join(s.select("chunk_id"), "chunk_id", "left_anti")
        elif out is not None:
            rows = rows.join(out.select("chunk_id"), "chunk_id", "left_anti")
        out = rows if out is None else out.unionByName(rows)
    return out


def cached_reads(requests: DataFrame, cached: DataFrame, primary: DataFrame, budget: int | None = None) -> DataFrame:
    """(ord, chunk_id, outcome: hit, miss_fill, miss_refused or not_found) of requests in order, through a cache that is never emptied.

    requests: ord, chunk_id. cached: chunk_id, length. primary: chunk_id, length. A chunk is filled in if it fits what is left of
    the budget when it is first asked for, so the fold goes over first requests in order: one sequence by nature, held by one cache.
    Without a budget nothing depends on the order of others, and no fold is made."""
    at = requests.join(cached.select("chunk_id", F.lit(True).alias("has")), "chunk_id", "left").join(primary.select("chunk_id", "length"), "chunk_id", "left")
    turn = F.row_number().over(Window.partitionBy("chunk_id").orderBy("ord"))
    at = at.withColumn("turn", turn)
    if budget is None:
        outcome = F.when(F.col("has"), "hit").when(F.col("length").isNull(), "not_found").when(F.col("turn") == 1, "miss_fill").otherwise("hit")
        return at.select("ord", "chunk_id", outcome.alias("outcome"))
    used = cached.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("used")).first().used

    def fold(key, batches):
        import pyarrow as pa

        held, bytes_ = set(), used
        for b in batches:
            rows = b.to_pylist()
            out = []
            for r in rows:
                if r["chunk_id"] in held:
                    out.append("hit")
                elif bytes_ + r["length"] <= budget:
                    held.add(r["chunk_id"])
                    bytes_ += r["length"]
                    out.append("miss_fill")
                else:
                    out.append("miss_refused")
            yield pa.RecordBatch.from_pydict({"ord": [r["ord"] for r in rows], "chunk_id": [r["chunk_id"] for r in rows], "outcome": out}, schema=pa.schema([("ord", pa.int64()), ("chunk_id", pa.string()), ("outcome", pa.string())]))

    settled = at.where("has or length is null").select(F.col("ord").cast("long"), "chunk_id", F.when(F.col("has"), "hit").otherwise("not_found").alias("outcome"))
    asked = at.where("has is null and length is not null").select(F.col("ord").cast("long").alias("ord"), "chunk_id", "length")
    one = asked.coalesce(1).sortWithinPartitions("ord").mapInArrow(lambda bs: fold(None, bs), "ord long, chunk_id string, outcome string")
    return settled.unionByName(one)


def cache_report(reads: DataFrame) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("outcome") == s, 1))
    return reads.agg(n("hit").alias("cache_hits"), n("miss_fill").alias("cache_miss_fills"), n("miss_refused").alias("cache_miss_refused"))


def chunk_url(base: Column, chunk_id: Column) -> Column:
    """`base/chunks/<2 digits>/<62 digits>.cnk`."""
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/chunks/"), F.substring(chunk_id, 1, 2), F.lit("/"), F.substring(chunk_id, 3, 62), F.lit(".cnk"))

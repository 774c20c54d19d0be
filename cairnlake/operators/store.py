"""Content-addressed stores as partitioned Parquet tables.

A store's folder holds `meta.toml`, `manifest.json` and generations of chunks, partitioned by the ids' first two digits, so that a
lookup reads one partition and joins prune. Writers add a generation; removal rewrites only the prefixes that lose chunks; the
manifest, replaced at last, says which (generation, prefix) count. A task that runs twice or a writer that dies leaves nothing
visible. There is one writer at a time.
"""

from __future__ import annotations

import dataclasses
import json
import tomllib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions.batches import bounded
from ..functions.hashing import content_id, parse_id, prefix
from ..schema import STORE, ChunkCorrupt, ChunkNotFound, IdMismatch, StoreError
from ..sources import fs

#: Fixed values of the metadata format.
MAGIC = "CFSTORE"
VERSION = 1
#: Ids that are broadcast at most, to keep payloads of others where they lie.
MOST = 2_000_000


def meta_text(compression: str) -> str:
    return f'magic = "{MAGIC}"\nversion = {VERSION}\ncompression = "{compression}"\n'


def parse_meta(text: str) -> str:
    """The compression; StoreError if magic, version or compression is missing or wrong. Other keys don't matter."""
    try:
        meta = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise StoreError(f"store metadata: {e}") from e
    if meta.get("magic") != MAGIC:
        raise StoreError(f"store metadata: magic {meta.get('magic')!r}")
    if meta.get("version") != VERSION:
        raise StoreError(f"store metadata: version {meta.get('version')!r}")
    try:
        return codecs.parse_compression(meta.get("compression", ""), ignore_case=False)
    except ValueError as e:
        raise StoreError(f"store metadata: {e}") from e


@dataclasses.dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str
    compression: str = "none"
    algorithm: str = "sha256"

    @classmethod
    def create(cls, spark: SparkSession, path: str, compression: str = "none", algorithm: str = "sha256") -> Store:
        compression = codecs.parse_compression(compression)
        if fs.exists(spark, f"{path}/meta.toml"):
            raise StoreError(f"{path} is a store already")
        fs.write(spark, f"{path}/manifest.json", json.dumps({}))
        fs.write(spark, f"{path}/meta.toml", meta_text(compression))
        return cls(spark, path, compression, algorithm)

    @classmethod
    def open(cls, spark: SparkSession, path: str, algorithm: str = "sha256") -> Store:
        if not fs.exists(spark, f"{path}/meta.toml"):
            raise StoreError(f"{path} is no store")
        return cls(spark, path, parse_meta(fs.read(spark, f"{path}/meta.toml")), algorithm)

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, compression: str | None = None, algorithm: str = "sha256") -> Store:
        """An explicit compression must agree with a store that exists; none given keeps it (new stores: none)."""
        if not fs.exists(spark, f"{path}/meta.toml"):
            return cls.create(spark, path, compression or "none", algorithm)
        store = cls.open(spark, path, algorithm)
        if compression is not None and codecs.parse_compression(compression) != store.compression:
            raise StoreError(f"{path} has compression {store.compression}, not {compression}")
        return store

    def _manifest(self) -> dict[str, list[str]]:
        return json.loads(fs.read(self.spark, f"{self.path}/manifest.json"))

    def _publish(self, manifest: dict[str, list[str]]) -> None:
        fs.write(self.spark, f"{self.path}/manifest.json", json.dumps({g: p for g, p in manifest.items() if p}), overwrite=True)

    def table(self, prefixes: list[str] | None = None) -> DataFrame:
        """chunk_id, len_plain, len_disk, payload (as stored), prefix."""
        folders = [f"{self.path}/generation={g}/prefix={p}" for g, ps in self._manifest().items() for p in ps if prefixes is None or p in prefixes]
        if not folders:
            return self.spark.createDataFrame([], STORE)
        read = self.spark.read.schema("chunk_id string, len_plain long, len_disk long, payload binary, generation string, prefix string").option("basePath", self.path)
        return bounded(read.parquet(*folders)).drop("generation")

    def ids(self) -> DataFrame:
        return self.table().select("chunk_id", "prefix")

    def chunks(self) -> DataFrame:
        """chunk_id and plain payload (null where it can't be decoded)."""
        return self.table().select("chunk_id", "prefix", codecs.decoded(F.col("payload"), self.compression).alias("payload"))

    def put(self, chunks: DataFrame, verify: bool = True, counted: bool = True) -> dict[str, int]:
        """Adds (chunk_id, payload) that the store lacks; {written, skipped}. Payloads that don't hash to their id: IdMismatch, nothing is added.

        Payloads are moved once, dealt out as they are written. A store that has chunks already is asked by id first, so that only
        payloads that are new are moved (all, if more than MOST are new); chunks is then read twice. Each of verify and counted
        (without which skipped is left out) reads it once more."""
        bounded(chunks)
        if verify:
            wrong = chunks.where(~content_id(F.col("payload"), self.algorithm).eqNullSafe(F.col("chunk_id"))).select("chunk_id").limit(1).collect()
            if wrong:
                raise IdMismatch(wrong[0].chunk_id)
        rows, held = chunks.select("chunk_id", "payload"), None
        if self._manifest():
            held = self.ids().select("chunk_id")
            rows = likely(rows, fs.kept(rows.select("chunk_id").distinct().join(held, "chunk_id", "left_anti")))
        one = self._one_each(rows, held)
        disk = codecs.encoded(F.col("payload"), self.compression)
        sized = one.select("chunk_id", "prefix", F.octet_length("payload").cast("long").alias("len_plain"), disk.alias("payload")).withColumn("len_disk", F.octet_length("payload").cast("long"))
        added = self._write(sized)
        written = sum(added.values())
        return {"written": written, "skipped": chunks.count() - written} if counted else {"written": written}

    def _placed(self, rows: DataFrame) -> DataFrame:
        """rows with prefix and place, dealt out by both.

        Ids are evenly spread hashes: a place is a range of them inside a prefix, about two for each partition of a shuffle (256 at
        least), so a prefix is split over many tasks in a large store and a task writes few folders."""
        n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        parts = -(-2 * n // 256)
        place = F.floor(F.conv(F.substring("chunk_id", 3, 4), 16, 10).cast("long") * parts / (1 << 16)).cast("int")
        return rows.withColumn("prefix", prefix(F.col("chunk_id"))).withColumn("place", place).repartition(n, "prefix", "place")

    def _one_each(self, rows: DataFrame, without: DataFrame | None = None) -> DataFrame:
        """One of the rows (chunk_id and others) of each id but the ids of `without`, with prefix, dealt out as they are written.

        Both are summed up by id after one move: a join would move payloads by id, and writing once more."""
        names = [c for c in rows.columns if c != "chunk_id"]
        rows = rows.select("chunk_id", F.struct(*names).alias("row"))
        if without is not None:
            rows = rows.unionByName(without.select("chunk_id", F.lit(None).cast(rows.schema["row"].dataType).alias("row")))
        one = self._placed(rows).groupBy("prefix", "place", "chunk_id").agg(F.first("row", ignorenulls=True).alias("row"), F.count(F.when(F.col("row").isNull(), 1)).alias("gone"))
        return one.where("gone = 0").select("chunk_id", "prefix", *(F.col("row")[c].alias(c) for c in names))

    def _write(self, rows: DataFrame, instead: dict[str, list[str]] | None = None) -> dict[str, int]:
        """Writes rows (chunk_id, len_plain, len_disk, payload, prefix), dealt out by _placed, as a new generation and publishes it
        beside the others, or beside `instead`; chunks by prefix. The files of plain payloads are compressed as Parquet does; what
        compression stands for, and len_disk, is the payload."""
        generation = uuid.uuid4().hex
        target = f"{self.path}/generation={generation}"
        out = rows.select("chunk_id", "len_plain", "len_disk", "payload", "prefix")
        out.sortWithinPartitions("prefix").write.partitionBy("prefix").option("compression", "zstd" if self.compression == "none" else "none").parquet(target)
        added = {r.prefix: r.n for r in self.spark.read.schema(STORE).parquet(target).groupBy("prefix").agg(F.count("*").alias("n")).collect()}  # at most 256 rows
        base = self._manifest() if instead is None else instead
        if added or instead is not None:
            self._publish(base | {generation: sorted(added)})
        return added

    def compact(self) -> int:
        """Rewrites all generations into one and deletes the others, so that a store of many small writes opens few files; no reader may be at work.

        The number of chunks. A store of one generation stays as it is."""
        old = list(self._manifest())
        if len(old) == 1:
            return self.table().count()
        added = self._write(self._placed(self.table()), instead={})
        for g in old:
            fs.delete(self.spark, f"{self.path}/generation={g}")
        return sum(added.values())

    def has(self, chunk_id: str) -> bool:
        parse_id(chunk_id)
        return bool(self.table([chunk_id[:2]]).where(F.col("chunk_id") == chunk_id).select("chunk_id").limit(1).collect())

    def get(self, chunk_id: str, verify: bool = False) -> bytes:
        """The plain payload; ChunkNotFound, or (verify) ChunkCorrupt."""
        parse_id(chunk_id)
        at = self.table([chunk_id[:2]]).where(F.col("chunk_id") == chunk_id).select(codecs.decoded(F.col("payload"), self.compression).alias("payload"))
        rows = at.withColumn("id", content_id(F.col("payload"), self.algorithm)).limit(1).collect()
        if not rows:
            raise ChunkNotFound(chunk_id)
        if rows[0].payload is None or (verify and rows[0].id != chunk_id):
            raise ChunkCorrupt(chunk_id)
        return bytes(rows[0].payload)

    def list(self) -> DataFrame:
        return self.ids().select("chunk_id").orderBy("chunk_id")

    def stats(self, decode: bool = False) -> DataFrame:
        """One row: chunks, bytes_on_disk, bytes_plaintext (null for compressed stores unless decoded), compression."""
        if self.compression == "none":
            plain = F.sum("len_disk")
        elif decode:
            plain = F.sum(F.octet_length(codecs.decoded(F.col("payload"), self.compression)).cast("long"))
        else:
            plain = F.lit(None).cast("long")
        return store_stats(self.table(), plain, self.compression)

    def remove(self, ids: DataFrame) -> int:
        """Deletes chunks by id; only prefixes that lose some are rewritten. The number deleted."""
        ids = ids.select("chunk_id").distinct().withColumn("prefix", prefix(F.col("chunk_id")))
        touched = sorted(r.prefix for r in self.table().join(ids, ["prefix", "chunk_id"], "left_semi").select("prefix").distinct().collect())  # at most 256
        if not touched:
            return 0
        before = self.table(touched)
        total = before.count()
        left = self._one_each(before.drop("prefix"), ids.where(F.col("prefix").isin(touched)))
        kept = self._write(left, {g: [p for p in ps if p not in touched] for g, ps in self._manifest().items()})
        return total - sum(kept.values())

    def gc(self, refs: list[DataFrame], apply: bool = False) -> dict[str, int | bool]:
        """What no listing refers to; deleted only with apply. There is no path scope: a smaller keep-set would delete live chunks."""
        kept = refs[0].select("chunk_id")
        for r in refs[1:]:
            kept = kept.unionByName(r.select("chunk_id"))
        kept = kept.distinct()
        loose = unreferenced(self.ids(), kept)
        n = loose.count()
        deleted = self.remove(loose) if apply and n else 0
        return {"dry_run": not apply, "applied": apply, "listings": len(refs), "referenced": kept.count(), "unreferenced": n, "deleted": deleted}

    def scrub(self, refs: DataFrame | None = None) -> DataFrame:
        """(chunk_id, status: ok, corrupt or unreadable) of all chunks, or of the distinct references; nothing is deleted."""
        return scrub_status(self.chunks().select("chunk_id", "payload"), refs, self.algorithm)


def likely(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """chunks without most of those whose id isn't one of `ids`, which should be a table. Nothing is moved but the ids' 64-bit hashes,
    to every task; all chunks where there are more than MOST ids. What stays must be compared by id."""
    if ids.count() > MOST:
        return chunks
    hashes = ids.select(F.xxhash64("chunk_id").alias("_hash"))
    return chunks.withColumn("_hash", F.xxhash64("chunk_id")).join(F.broadcast(hashes), "_hash", "left_semi").drop("_hash")


def store_stats(stored: DataFrame, plain, compression: str) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return stored.agg(F.count("*").alias("chunks"), zero(F.sum("len_disk")).alias("bytes_on_disk"), (zero(plain) if compression == "none" else plain.cast("long")).alias("bytes_plaintext")).withColumn("compression", F.lit(compression))


def unreferenced(stored: DataFrame, refs: DataFrame) -> DataFrame:
    """Stored ids that nothing refers to."""
    return stored.select("chunk_id").join(refs.select("chunk_id").distinct(), "chunk_id", "left_anti")


def missing(refs: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct referenced ids that aren't stored."""
    return refs.select("chunk_id").distinct().join(stored.select("chunk_id"), "chunk_id", "left_anti")


def doctor(listings: list[DataFrame], stored: DataFrame) -> DataFrame:
    """One row: listings, checked (references, repeats included), missing (distinct). References are summed up by id first."""
    every = listings[0].select("chunk_id")
    for r in listings[1:]:
        every = every.unionByName(r.select("chunk_id"))
    ids = every.groupBy("chunk_id").agg(F.count("*").alias("n")).join(stored.select("chunk_id", F.lit(True).alias("has")), "chunk_id", "left")
    return ids.agg(F.lit(len(listings)).cast("long").alias("listings"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("checked"), F.count(F.when(F.col("has").isNull(), 1)).alias("missing")).withColumn("ok", F.col("missing") == 0)


def scrub_status(chunks: DataFrame, refs: DataFrame | None = None, algorithm: str = "sha256") -> DataFrame:
    """chunks: chunk_id, payload (null: unreadable). With refs, what isn't stored is unreadable too."""
    status = F.when(F.col("payload").isNull(), "unreadable").when(content_id(F.col("payload"), algorithm) == F.col("chunk_id"), "ok").otherwise("corrupt")
    if refs is None:
        return chunks.select("chunk_id", status.alias("status"))
    wanted = refs.select("chunk_id").distinct()
    return wanted.join(chunks, "chunk_id", "left").select("chunk_id", status.alias("status"))


def scrub_report(statuses: DataFrame) -> DataFrame:
    """One row: checked, ok_count, corrupt, unreadable, ok."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    return statuses.agg(F.count("*").alias("checked"), n("ok").alias("ok_count"), n("corrupt").alias("corrupt"), n("unreadable").alias("unreadable")).withColumn("ok", F.col("corrupt") + F.col("unreadable") == 0)

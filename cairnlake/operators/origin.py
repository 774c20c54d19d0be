"""Where chunks come from and go to: local stores and HTTP endpoints behind one interface, fallbacks in order, a cache around them.

An origin answers has(ids) with the ids that it holds, and read(ids) with (chunk_id, payload, outcome): fetched, missing, or
failed_transient and failed_permanent, whose payload is null. HTTP requests are made by the tasks that hold the ids, one per
distinct id; their results are written to the shared scratch folder, so that no plan that reads them twice asks twice.
"""

from __future__ import annotations

import dataclasses
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import content_id
from ..schema import CairnError, ChunkCorrupt
from ..sources import fs, http
from ..sources.templates import file_path
from . import readpath, transfer
from .chunking import chunk_refs
from .store import Store


class Origin(Protocol):
    def has(self, ids: DataFrame) -> DataFrame: ...

    def read(self, ids: DataFrame) -> DataFrame: ...


@dataclasses.dataclass(frozen=True)
class StoreOrigin:
    store: Store

    def has(self, ids: DataFrame) -> DataFrame:
        return ids.select("chunk_id").distinct().join(self.store.ids().select("chunk_id"), "chunk_id", "left_semi")

    def read(self, ids: DataFrame) -> DataFrame:
        """A chunk that can't be decoded or has other content than its id says has failed."""
        return _read_frame(self.store.chunks(), ids, self.store.algorithm)


@dataclasses.dataclass(frozen=True)
class FrameOrigin:
    """Chunks that are a DataFrame (chunk_id, payload)."""

    chunks: DataFrame
    algorithm: str = "sha256"

    def has(self, ids: DataFrame) -> DataFrame:
        return ids.select("chunk_id").distinct().join(self.chunks.select("chunk_id"), "chunk_id", "left_semi")

    def read(self, ids: DataFrame) -> DataFrame:
        return _read_frame(self.chunks, ids, self.algorithm)


@dataclasses.dataclass(frozen=True)
class HttpOrigin:
    endpoint: http.Endpoint

    def has(self, ids: DataFrame) -> DataFrame:
        return http.present(ids, self.endpoint).where("present").select("chunk_id")

    def read(self, ids: DataFrame) -> DataFrame:
        return fs.kept(http.fetch(ids, self.endpoint).select("chunk_id", "payload", "outcome"))


def _read_frame(chunks: DataFrame, ids: DataFrame, algorithm: str) -> DataFrame:
    at = ids.select("chunk_id").distinct().join(chunks.select("chunk_id", "payload", F.lit(True).alias("there")), "chunk_id", "left")
    good = content_id(F.col("payload"), algorithm) == F.col("chunk_id")
    outcome = F.when(F.col("there").isNull(), "missing").when(F.coalesce(good, F.lit(False)), "fetched").otherwise("failed_permanent")
    at = at.withColumn("outcome", outcome)
    return at.select("chunk_id", F.when(F.col("outcome") == "fetched", F.col("payload")).alias("payload"), "outcome")


def is_http(spec: str) -> bool:
    return spec.strip().startswith(("http://", "https://"))


def open_origin(spark: SparkSession, spec: str, algorithm: str = "sha256", **options) -> Origin:
    """By its address: http(s)://, or a store's folder (a path, file://, or whatever Spark reads). options: of http.Endpoint."""
    if is_http(spec):
        return HttpOrigin(http.Endpoint(spec.strip(), algorithm=algorithm, **options))
    path = file_path(spec)
    return StoreOrigin(Store.open(spark, spec if path is None else f"file://{path}" if spec.startswith("file:") else spec, algorithm))


@dataclasses.dataclass(frozen=True)
class Fallback:
    """The first origin that has a chunk; only absence moves on to the next, a failure ends the search."""

    origins: tuple[Origin, ...]

    def __post_init__(self) -> None:
        if not self.origins:
            raise ValueError("no origin")

    def has(self, ids: DataFrame) -> DataFrame:
        out, left = None, ids.select("chunk_id").distinct()
        for o in self.origins:
            got = o.has(left)
            out = got if out is None else out.unionByName(got)
            left = left.join(got, "chunk_id", "left_anti")
        return out

    def read(self, ids: DataFrame) -> DataFrame:
        out, left = None, ids.select("chunk_id").distinct()
        for k, o in enumerate(self.origins):
            got = o.read(left)
            last = k + 1 == len(self.origins)
            rows = got if last else got.where("outcome <> 'missing'")
            out = rows if out is None else out.unionByName(rows)
            left = got.where("outcome = 'missing'").select("chunk_id")
        return out


def cached_read(origin: Origin, cache: Store, requests: DataFrame, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(reads, report): chunks by way of a cache that is never emptied, and its counters cache_hits, cache_miss_fills, cache_miss_refused.

    requests: ord, chunk_id. What the cache lacks is read from the origin once; in the order of requests, chunks are filled in as
    long as they fit the budget, others are passed on."""
    ids = requests.select("chunk_id").distinct()
    held = cache.ids().select("chunk_id")
    rows = fs.kept(origin.read(ids.join(held, "chunk_id", "left_anti")))
    got = rows.where("outcome = 'fetched'")
    sizes = cache.table().select("chunk_id", F.col("len_plain").alias("length"))
    turns = fs.kept(transfer.cached_reads(requests, sizes, got.select("chunk_id", F.octet_length("payload").cast("long").alias("length")), budget))
    # as it was before chunks are filled in
    old = fs.kept(cache.chunks().select("chunk_id", "payload").join(ids, "chunk_id", "left_semi").withColumn("outcome", F.lit("hit")))
    fill = turns.where("outcome = 'miss_fill'").select("chunk_id")
    cache.put(got.join(fill, "chunk_id", "left_semi").select("chunk_id", "payload"), counted=False)
    return old.unionByName(rows), transfer.cache_report(turns)


def payloads(reads: DataFrame) -> DataFrame:
    """(chunk_id, payload) of what was read, as readpath takes it."""
    return reads.where("payload is not null").select("chunk_id", "payload")


def verify(entries: DataFrame, origin: Origin, algorithm: str = "sha256") -> DataFrame:
    """readpath.verify against an origin: all files and symlinks of the listing."""
    return readpath.verify(entries, payloads(origin.read(chunk_refs(entries.where("kind = 'file'")))), algorithm)


def verified(listings: list[DataFrame], origin: Origin, algorithm: str = "sha256") -> DataFrame:
    """One row per listing, in order: listing, files, chunks, symlinks, faults, first_fault, ok. The whole listings, whatever was moved."""
    out = None
    for k, entries in enumerate(listings):
        one = readpath.verify_report(verify(entries, origin, algorithm)).withColumn("listing", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def check_verified(listings: list[DataFrame], origin: Origin, what: str, algorithm: str = "sha256") -> int:
    """The number of listings; ChunkCorrupt with the first fault if one isn't whole at the origin."""
    for r in verified(listings, origin, algorithm).orderBy("listing").collect():  # a row per listing
        if not r.ok:
            raise ChunkCorrupt(f"{what}: listing {r.listing}: {r.first_fault}")
    return len(listings)


def doctor(listings: list[DataFrame], origin: Origin, deep: bool = False) -> DataFrame:
    """One row: listings, checked (references, repeats included), missing (distinct), deep, ok. deep reads and hashes every chunk in place of
    asking for its presence; one that is there but can't be read raises CairnError with the smallest such id."""
    every = None
    for e in listings:
        refs = chunk_refs(e).select("chunk_id")
        every = refs if every is None else every.unionByName(refs)
    ids = every.groupBy("chunk_id").agg(F.count("*").alias("n"))
    if deep:
        seen = fs.kept(origin.read(ids).select("chunk_id", "outcome"))
        bad = seen.where("outcome like 'failed%'").agg(F.min("chunk_id").alias("id")).first().id
        if bad:
            raise CairnError(f"chunk {bad} can't be read")
        there = seen.where("outcome <> 'missing'")
    else:
        there = origin.has(ids)
    at = ids.join(there.select("chunk_id", F.lit(True).alias("has")), "chunk_id", "left")
    out = at.agg(F.lit(len(listings)).cast("long").alias("listings"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("checked"), F.count(F.when(F.col("has").isNull(), 1)).alias("missing"))
    return out.withColumn("deep", F.lit(deep)).withColumn("ok", F.col("missing") == 0)


def summary(origin: Origin, probe: bool = True) -> dict:
    """What doctor says of the origin itself: a store's metadata, or whether an endpoint answers (CairnError if not)."""
    if isinstance(origin, StoreOrigin):
        return {"kind": "store", "path": origin.store.path, "compression": origin.store.compression, "algorithm": origin.store.algorithm}
    if isinstance(origin, HttpOrigin):
        if probe and not origin.endpoint.reachable():
            raise CairnError(f"{origin.endpoint.base} doesn't answer")
        return {"kind": "http", "base": origin.endpoint.base, "probed": probe}
    return {"kind": type(origin).__name__.lower()}


def check_flags(specs: list[str], http_options: bool = False, cache: str | None = None, cache_max_bytes: int | None = None, jobs: int = 1, dest: str | None = None, compression: str | None = None) -> None:
    """ValueError for options that don't go together: no origin; URL or header options without an HTTP origin; a cache's budget without
    a cache; fewer than one job; HTTP options for a local destination, a compression for one behind HTTP."""
    if dest is None and not specs:
        raise ValueError("no origin")
    if cache_max_bytes is not None and cache is None:
        raise ValueError("a cache budget needs a cache")
    if jobs < 1:
        raise ValueError(f"jobs must be at least 1, not {jobs}")
    if dest is not None:
        if http_options and not is_http(dest):
            raise ValueError("URL and header options need an HTTP destination")
        if compression is not None and is_http(dest):
            raise ValueError("a destination behind HTTP has no compression of its own")
    elif http_options and not any(map(is_http, specs)):
        raise ValueError("URL and header options need an HTTP origin")


def upload(listings: list[DataFrame], local: Store, endpoint: http.Endpoint, scope_refs: DataFrame, method: str = "PUT") -> tuple[DataFrame, DataFrame]:
    """(outcomes, report) of pushing the references to an endpoint: what isn't local fails, whatever the endpoint has; each other chunk
    is uploaded once, or skipped if it is there, or in the bucket of its failure."""
    ids = scope_refs.select("chunk_id").distinct()
    sent = fs.kept(http.upload(local.chunks().join(ids, "chunk_id", "left_semi").select("chunk_id", "payload"), endpoint, method))
    outcomes = ids.join(sent.select("chunk_id", "outcome"), "chunk_id", "left").select("chunk_id", F.coalesce("outcome", F.lit("failed_permanent")).alias("outcome"))
    return outcomes, transfer.outcome_report(outcomes, "uploaded", len(listings))


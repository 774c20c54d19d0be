"""Making listings: single blobs (make) and trees (archive), with scopes, seeds and dry runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pathfilter import PathFilter
from ..schema import ChunkNotFound, ChunkParams
from ..sources import fs, http
from . import origin, transfer
from . import seed as seeds
from .chunking import blob_payloads, chunk_refs, dedup_counters, with_chunks
from .listing import LEAVES, union_refs
from .store import Store, likely


def archive(blobs: DataFrame, store: Store | None, scope: PathFilter = PathFilter(), params: ChunkParams | None = None, fixed: int | None = None, prior: DataFrame | None = None, trust_mtime: bool = False, dry_run: bool = False) -> tuple[DataFrame, dict]:
    """(entries, counts) of a tree (schema.BLOBS): files in scope are cut, chunks that the store lacks are added.

    Scope applies before any content is read. Files that prior decides to reuse, and whose chunks are all stored, keep their prior
    entry, old mode and mtime included; a reused file that lacks chunks is cut anew (seed_missing). Counts: files, dirs, chunks,
    written and reused (dry run: would_write, would_reuse), seed_reused_files, rechunked_files, seed_missing, recorded_symlinks, excluded."""
    algorithm = store.algorithm if store else "sha256"
    inside = blobs.where(scope.allows(F.col("path")))
    excluded = blobs.where(~scope.allows(F.col("path"))).count()
    stored = store.ids() if store else None
    reused = None
    if prior is not None and store is not None:
        shape = inside.drop("content")
        ask = seeds.needs_hash(shape, prior, trust_mtime).select("path")
        hashed = inside.join(ask, "path", "left_semi").select("path", F.sha2("content", 256).alias("blob_id") if algorithm == "sha256" else _blake3("content"))
        decided = seeds.decisions(shape.join(hashed, "path", "left"), prior, trust_mtime)
        reused = seeds.reusable(decided, prior, stored)
    if reused is not None:
        keep = reused.where("decision = 'reuse'").select("path")
        fresh = inside.join(keep, "path", "left_anti")
        old = prior.join(keep, "path", "left_semi")
    else:
        fresh, old = inside, None
    entries = with_chunks(fresh, fixed, params, algorithm)
    refs = chunk_refs(entries.where("kind = 'file'"))
    counters = dedup_counters(refs, stored).first()
    if store is not None and not dry_run:
        store.put(blob_payloads(fresh, fixed, params, algorithm), verify=False, counted=False)
    if old is not None:
        entries = entries.unionByName(old.select(*entries.columns))
    kinds = {r.kind: r.n for r in entries.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    old_refs = chunk_refs(old).count() if old is not None else 0
    old_files = old.count() if old is not None else 0
    names = ("would_write", "would_reuse") if dry_run else ("written", "reused")
    counts = {"ok": True, "dry_run": dry_run, "files": kinds.get("file", 0), "dirs": kinds.get("dir", 0), "chunks": counters.chunks + old_refs, names[0]: counters.new, names[1]: counters.reused + old_refs}
    counts |= {"seed_reused_files": old_files, "rechunked_files": kinds.get("file", 0) - old_files, "seed_missing": reused.where("seed_missing").count() if reused is not None else 0, "recorded_symlinks": kinds.get("symlink", 0), "excluded": excluded}
    return entries.orderBy("path"), counts


def _blake3(column: str):
    from ..functions.hashing import content_id

    return content_id(F.col(column), "blake3").alias("blob_id")


def make(blob: DataFrame, store: Store | None, params: ChunkParams | None = None, fixed: int | None = None, prior: DataFrame | None = None, dry_run: bool = False) -> tuple[DataFrame, dict]:
    """(entry, counts) of one blob: bytes, chunks, new and reused (dry run: would_write, would_reuse), seed_reused with a seed.

    prior: the one entry of an earlier listing; equal size and content reuse its chunks, which must all be stored (ChunkNotFound)."""
    algorithm = store.algorithm if store else "sha256"
    names = ("would_write", "would_reuse") if dry_run else ("new", "reused")
    entry = with_chunks(blob, fixed, params, algorithm)
    same = None
    if prior is not None:
        now = entry.select("size", "blob_id").first()
        before = prior.select("size", "blob_id").first()
        same = (now["size"], now["blob_id"]) == (before["size"], before["blob_id"])
        if same:
            refs = chunk_refs(prior)
            if store is None or refs.join(store.ids(), "chunk_id", "left_anti").limit(1).count():
                raise ChunkNotFound("a chunk of the seed isn't stored")
            total = refs.count()
            return prior, {"ok": True, "bytes": now["size"], "chunks": total, names[0]: 0, names[1]: total, "seed_reused": True}
    counters = dedup_counters(chunk_refs(entry), store.ids() if store else None).first()
    if store is not None and not dry_run:
        store.put(blob_payloads(blob, fixed, params, algorithm), verify=False, counted=False)
    counts = {"ok": True, "bytes": counters.bytes, "chunks": counters.chunks, names[0]: counters.new, names[1]: counters.reused}
    return entry, counts | ({"seed_reused": False} if same is not None else {}) | ({"dry_run": True} if dry_run else {})


def _refs(listings: list[DataFrame], scope: PathFilter) -> DataFrame:
    return union_refs([e.where(F.col("kind").isin(*LEAVES) & scope.allows(F.col("path"))) for e in listings])


def _settled(report: dict, listings: list[DataFrame], at, verify: bool, dry_run: bool, what: str, algorithm: str) -> dict:
    """report, with `verified`: listings that were read back whole and hashed, however small the scope was; null where nothing was moved or a chunk failed."""
    if not verify:
        return report
    return report | {"verified": origin.check_verified(listings, at, what, algorithm) if report["ok"] and not dry_run else None}


def push(listings: list[DataFrame], local: Store, remote: Store | http.Endpoint, scope: PathFilter = PathFilter(), dry_run: bool = False, verify: bool = False, method: str = "PUT") -> dict:
    """Adds to remote (a store, or an endpoint) the chunks of the listings that it lacks; what isn't local fails. A dry run counts what
    would be uploaded. verify: after a push without failure, the whole listings are read back from remote (ChunkCorrupt)."""
    refs = _refs(listings, scope)
    if isinstance(remote, Store):
        at = origin.StoreOrigin(remote)
        outcomes = fs.kept(transfer.push_outcomes(refs, local.ids(), remote.ids()))
        report = transfer.outcome_report(outcomes, "uploaded", len(listings), dry_run).first().asDict()
        if not dry_run:
            todo = outcomes.where("outcome = 'uploaded'").select("chunk_id")
            moved = likely(local.chunks().select("chunk_id", "payload"), todo).join(todo, "chunk_id", "left_semi")
            remote.put(fs.kept(moved), counted=False)  # read up to three times
    else:
        at = origin.HttpOrigin(remote)
        if dry_run:
            report = transfer.outcome_report(transfer.push_outcomes(refs, local.ids(), at.has(refs)), "uploaded", len(listings), True).first().asDict()
        else:
            report = origin.upload(listings, local, remote, refs, method)[1].first().asDict()
    return _settled(report, listings, at, verify, dry_run, "push", local.algorithm)


def pull(listings: list[DataFrame], local: Store, remote: Store | http.Endpoint | origin.Origin, scope: PathFilter = PathFilter(), dry_run: bool = False, verify: bool = False) -> dict:
    """Adds to local the chunks of the listings that it lacks, from remote: a store, an endpoint or any origin. verify: after a pull without
    failure, the whole listings are read back from local (ChunkCorrupt)."""
    at = origin.StoreOrigin(remote) if isinstance(remote, Store) else origin.HttpOrigin(remote) if isinstance(remote, http.Endpoint) else remote
    refs = _refs(listings, scope)
    if dry_run:
        there = refs if isinstance(at, origin.HttpOrigin) else at.has(refs)
        return transfer.outcome_report(transfer.pull_outcomes(refs, local.ids(), there), "fetched", len(listings), True).first().asDict() | ({"verified": None} if verify else {})
    ids = refs.select("chunk_id").distinct()
    lacking = ids.join(local.ids().select("chunk_id"), "chunk_id", "left_anti")
    got = fs.kept(at.read(lacking))
    failures = got.select("chunk_id", F.when(F.col("outcome") == "failed_transient", "transient").when(F.col("outcome") == "failed_permanent", "permanent").alias("error_class")).where("error_class is not null")
    report = transfer.outcome_report(transfer.pull_outcomes(refs, local.ids(), got.where("outcome <> 'missing'"), failures), "fetched", len(listings)).first().asDict()
    local.put(origin.payloads(got), counted=False)
    return _settled(report, listings, origin.StoreOrigin(local), verify, False, "pull", local.algorithm)

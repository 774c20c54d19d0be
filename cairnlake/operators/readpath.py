"""Reading back: reassembly, verification, byte ranges, extraction."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import bounded
from ..functions.hashing import hash_streams, hasher
from ..functions.paths import check_path
from ..schema import CairnError
from ..sources import fs
from .chunking import chunk_refs
from .listing import lookup_file


def pieces(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """References of files with their payload (null: not stored): path, ord, start_offset, end_offset, length, chunk_id, payload.

    stored: chunk_id, payload. The payload of a chunk that very many files share is sent once for each; the join is split where its
    references are skewed (AQE), which sees their number, not the bytes that they turn into."""
    refs = chunk_refs(entries.where("kind = 'file'"))
    return refs.join(stored.select("chunk_id", "payload"), "chunk_id", "left")


def folded(rows: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Per path of rows (path, ord, length, payload): n_chunks, size, blob_id of the concatenation, first fault by lowest ord.

    Pieces are dealt out by path and sorted; each task hashes a file as its pieces stream by, so no file has to fit in a row."""

    schema = pa.schema([("path", pa.string()), ("n_chunks", pa.int64()), ("size", pa.int64()), ("blob_id", pa.string()), ("fault", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n, size, fault, h = None, 0, 0, None, hasher(algorithm)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"path": path, "n_chunks": n, "size": size, "blob_id": h.hexdigest(), "fault": fault}], schema=schema)

        for b in batches:
            paths, ords, lengths, ids = (b.column(c).to_pylist() for c in ("path", "ord", "length", "chunk_id"))
            for now, ord_, length, chunk_id, cell in zip(paths, ords, lengths, ids, b.column("payload"), strict=True):
                if now != path:
                    if path is not None:
                        yield out()
                    path, n, size, fault, h = now, 0, 0, None, hasher(algorithm)
                n += 1
                data = cell.as_py()
                found = "missing chunk" if data is None else "wrong length" if len(data) != length else "corrupt chunk" if hash_streams(iter([data]), algorithm) != chunk_id else None
                fault = fault or (found and f"{ord_}: {found}")
                size += len(data or b"")
                h.update(data or b"")
        if path is not None:
            yield out()

    src = bounded(rows).select("path", "ord", "length", "chunk_id", "payload").repartition("path").sortWithinPartitions("path", "ord")
    return src.mapInArrow(run, "path string, n_chunks long, size long, blob_id string, fault string")


def verify(entries: DataFrame, stored: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """(path, kind, chunks, fault) of files and symlinks; fault is null where all is well: chunks there, of right length and id,
    size and blob as listed; symlink targets relative."""
    files = entries.where("kind = 'file'").select("path", F.col("size").alias("listed"), F.col("blob_id").alias("listed_id"), F.size("chunks").alias("n"))
    got = folded(pieces(entries, stored), algorithm)
    empty = hash_streams(iter([b""]), algorithm)
    at = files.join(got, "path", "left")
    fault = F.coalesce(F.col("fault"), F.when(F.coalesce("size", F.lit(0)) != F.col("listed"), "size differs"), F.when(F.coalesce("blob_id", F.lit(empty)) != F.col("listed_id"), "blob differs"))
    out = at.select("path", F.lit("file").alias("kind"), F.coalesce("n_chunks", F.lit(0)).alias("chunks"), fault.alias("fault"))
    target = F.coalesce(F.col("target"), F.lit(""))
    links = entries.where("kind = 'symlink'").select("path", "kind", F.lit(0).cast("long").alias("chunks"), F.when(target == "", "empty target").when(target.startswith("/"), "absolute target").alias("fault"))
    return out.unionByName(links)


def verify_report(checked: DataFrame) -> DataFrame:
    """One row: files, chunks, symlinks, faults, ok, and the fault at the smallest path."""
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    first = F.min_by(F.concat_ws(": ", "path", "fault"), F.when(F.col("fault").isNotNull(), F.col("path")))
    return checked.agg(n("file").alias("files"), F.coalesce(F.sum("chunks"), F.lit(0)).cast("long").alias("chunks"), n("symlink").alias("symlinks"), F.count("fault").alias("faults"), first.alias("first_fault")).withColumn("ok", F.col("faults") == 0)


def cat(entries: DataFrame, stored: DataFrame, path: str) -> DataFrame:
    """(ord, payload) of one file, in order; lengths are checked, the blob's hash isn't."""
    one = lookup_file(entries, path)
    at = pieces(one, stored).where("payload is not null and octet_length(payload) = length")
    return at.select("ord", "payload").orderBy("ord")


def cat_bytes(entries: DataFrame, stored: DataFrame, path: str) -> bytes:
    """The file's bytes, on the driver one chunk at a time."""
    want = lookup_file(entries, path).select(F.size("chunks").alias("n"), "size").first()
    out = [bytes(r.payload) for r in cat(entries, stored, path).toLocalIterator()]
    if len(out) != max(want.n, 0) or sum(map(len, out)) != want.size:
        raise CairnError(f"{path}: chunks are missing or of wrong length")
    return b"".join(out)


def read_range(entries: DataFrame, stored: DataFrame, offset: int | Column, size: int | Column) -> DataFrame:
    """Per file: path, start_offset, payload slices (ordered by start_offset) of bytes [offset, offset + size); nothing beyond the end.

    Only chunks that overlap the range are looked up."""
    lo = F.lit(offset) if isinstance(offset, int) else offset
    hi = lo + (F.lit(size) if isinstance(size, int) else size)
    refs = chunk_refs(entries.where("kind = 'file'")).where((F.col("start_offset") < hi) & (F.col("end_offset") > lo))
    at = refs.join(stored.select("chunk_id", "payload"), "chunk_id")
    a = F.greatest(lo - F.col("start_offset"), F.lit(0))
    b = F.least(hi - F.col("start_offset"), F.col("length"))
    return at.select("path", F.greatest(F.col("start_offset"), lo).alias("start_offset"), F.substring("payload", (a + 1).cast("int"), (b - a).cast("int")).alias("payload"))


def unchanged_verdict(entries: DataFrame, inventory: DataFrame, trust_mtime: bool = False) -> DataFrame:
    """(path, verdict) of listed files against what lies at the destination (path, kind, size, mtime_secs, blob_id)."""
    there = inventory.select("path", F.struct("kind", "size", "mtime_secs", "blob_id").alias("d"))
    at = entries.where("kind = 'file'").join(there, "path", "left")
    verdict = (
        F.when(F.col("d").isNull(), "missing").when(F.col("d.kind") != "file", "type_mismatch").when(F.col("d.size") != F.col("size"), "size_mismatch")
        .when(F.lit(trust_mtime) & (F.col("d.mtime_secs") == F.col("mtime_secs")), "unchanged").when(F.col("d.blob_id").eqNullSafe(F.col("blob_id")), "unchanged").otherwise("content_mismatch")
    )
    return at.select("path", verdict.alias("verdict"))


def extract_plan(entries: DataFrame, inventory: DataFrame, force: bool = False, skip_unchanged: bool = False, trust_mtime: bool = False) -> DataFrame:
    """(path, kind, action: write, skip or fail). Existing files need force; a type never changes; skipping what is unchanged comes
    before force; symlinks must be relative, force replaces symlinks only, an equal one is skipped on demand; a directory that exists is no conflict."""
    there = inventory.select("path", F.struct("kind", "size", "mtime_secs", "blob_id", "target").alias("d"))
    at = entries.join(there, "path", "left")
    d, kind = F.col("d"), F.col("kind")
    dir_there = d["kind"] == "dir"
    same = (d["kind"] == "file") & (d["size"] == F.col("size")) & ((F.lit(trust_mtime) & (d["mtime_secs"] == F.col("mtime_secs"))) | d["blob_id"].eqNullSafe(F.col("blob_id")))
    overwrite = F.when(F.lit(force), "write").otherwise("fail")
    file = F.when(d.isNull(), "write").when(dir_there, "fail").when(F.lit(skip_unchanged) & same, "skip").otherwise(overwrite)
    folder = F.when(d.isNull() | dir_there, "write").otherwise("fail")
    target = F.coalesce(F.col("target"), F.lit(""))
    link = (
        F.when((target == "") | target.startswith("/"), "fail").when(d.isNull(), "write").when(d["kind"] != "symlink", "fail")
        .when(F.lit(skip_unchanged) & (d["target"] == target), "skip").otherwise(overwrite)
    )
    return at.select("path", "kind", F.when(kind == "file", file).when(kind == "dir", folder).otherwise(link).alias("action"))


def plan_report(plan: DataFrame) -> DataFrame:
    """One row: would_skip, would_write (files and symlinks), would_dirs, would_fail, would_symlinks."""
    n = lambda c: F.count(F.when(c, 1))
    a, k = F.col("action"), F.col("kind")
    return plan.agg(n(a == "skip").alias("would_skip"), n((a == "write") & (k != "dir")).alias("would_write"), n((a == "write") & (k == "dir")).alias("would_dirs"), n(a == "fail").alias("would_fail"), n((a == "write") & (k == "symlink")).alias("would_symlinks"))


def extract(entries: DataFrame, stored: DataFrame, root: str, force: bool = False) -> DataFrame:
    """Writes a listing below root, a folder that all executors mount; (path, kind, done). Files get their mode, not their mtime; nothing else is deleted.

    Directories first, then files, each streamed by one task in the order of its chunks, then symlinks. The rows of files are a table
    in the shared scratch folder; directories and symlinks, a row each, are made by the driver."""
    for row in entries.where("kind = 'dir'").select("path", "mode").toLocalIterator():
        at = os.path.join(root, check_path(row.path))
        os.makedirs(at, exist_ok=True)
        os.chmod(at, row.mode & 0o7777)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, out = None, None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal out
            if out:
                out.close()
                os.chmod(out.name, mode & 0o7777)
                os.replace(out.name, out.name[: -len(".part")])
                out = None
                yield pa.RecordBatch.from_pydict({"path": [done], "kind": ["file"], "done": [True]})

        for b in batches:
            for r in b.to_pylist():
                if r["path"] != done:
                    yield from close()
                    done, mode = r["path"], r["mode"]
                    at = os.path.join(root, check_path(done))
                    if os.path.isdir(at) or (os.path.lexists(at) and not force):
                        raise CairnError(f"{at} exists")
                    os.makedirs(os.path.dirname(at), exist_ok=True)
                    out = open(at + ".part", "wb")
                if r["ord"] is not None:
                    if r["payload"] is None or len(r["payload"]) != r["length"]:
                        raise CairnError(f"{done}: chunk {r['ord']} is missing or of wrong length")
                    out.write(r["payload"])
        yield from close()

    files = entries.where("kind = 'file'").select("path", "mode")
    rows = files.join(pieces(entries, stored), "path", "left").select("path", "mode", "ord", "length", "payload")
    spark, report = entries.sparkSession, fs.scratch(entries.sparkSession)
    bounded(rows).repartition("path").sortWithinPartitions("path", "ord").mapInArrow(write, "path string, kind string, done boolean").write.parquet(report)
    links = []
    for row in entries.where("kind = 'symlink'").select("path", "target").toLocalIterator():
        at = os.path.join(root, check_path(row.path))
        if not row.target or row.target.startswith("/"):
            raise CairnError(f"{row.path}: target {row.target!r}")
        if os.path.lexists(at):
            if not (force and os.path.islink(at)):
                raise CairnError(f"{at} exists")
            os.unlink(at)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        os.symlink(row.target, at)
        links.append((row.path, "symlink", True))
    schema = "path string, kind string, done boolean"
    return spark.read.schema(schema).parquet(report).unionByName(spark.createDataFrame(links, schema))

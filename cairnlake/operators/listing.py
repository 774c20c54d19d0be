"""Listings: scopes, directory views and validation. A listing is a DataFrame of entries (schema.ENTRIES)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths
from ..functions.pathfilter import PathFilter
from ..schema import CairnError, InvalidPath
from .chunking import chunk_refs

LEAVES = ("file", "symlink")


def filtered(entries: DataFrame, scope: PathFilter) -> DataFrame:
    """The sub-listing in scope: allowed files and symlinks, directories above a kept one, and directories allowed themselves.

    Ancestors are exploded from the kept leaves and joined by equality, so nothing compares every directory with every leaf."""
    if scope.empty:
        return entries
    allowed = scope.allows(F.col("path"))
    leaves = entries.where(F.col("kind").isin(*LEAVES) & allowed)
    above = leaves.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    dirs = entries.where(F.col("kind") == "dir")
    kept = dirs.where(allowed).unionByName(dirs.where(~allowed).join(above, "path", "left_semi"))
    return leaves.unionByName(kept)


def scope_counts(entries: DataFrame, scope: PathFilter) -> DataFrame:
    """One row: files, dirs, symlinks kept, and excluded leaves."""
    kept = filtered(entries, scope).agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(n) for k, n in (("file", "files"), ("dir", "dirs"), ("symlink", "symlinks"))])
    out = entries.agg(F.count(F.when(F.col("kind").isin(*LEAVES) & ~scope.allows(F.col("path")), 1)).alias("excluded"))
    return kept.crossJoin(F.broadcast(out))  # one row each


def kind_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("kind").agg(F.count("*").alias("n"))


def ls(entries: DataFrame, scope: PathFilter = PathFilter(), chunks: bool = False) -> DataFrame:
    """kind, path, size (files), target (symlinks) and, on demand, chunk ids, by path; chunk payloads are never read."""
    out = filtered(entries, scope)
    columns = [F.col("kind"), F.col("path"), F.when(F.col("kind") == "file", F.col("size")).alias("size"), F.when(F.col("kind") == "symlink", F.col("target")).alias("target")]
    if chunks:
        columns.append(F.when(F.col("kind") == "file", F.transform("chunks", lambda c: c["chunk_id"])).alias("chunks"))
    return out.select(*columns).orderBy("path")


def tree(entries: DataFrame, root_mode: int = 0o555) -> DataFrame:
    """entries with the directories that paths imply but the listing lacks (mode 0555, the root as an empty path), with parent and name."""
    implied = entries.select(F.explode(F.array_append(paths.ancestors(F.col("path")), F.lit(""))).alias("path")).distinct()
    missing = implied.join(entries.select("path"), "path", "left_anti").select("path", F.lit("dir").alias("kind"), F.lit(root_mode).cast("long").alias("mode"))
    every = entries.unionByName(missing, allowMissingColumns=True)
    return every.withColumn("parent", F.when(F.col("path") != "", paths.parent(F.col("path")))).withColumn("name", paths.base_name(F.col("path")))


def _at_or_below(entries: DataFrame, path: str) -> DataFrame:
    """The part of a listing that a lookup needs; the condition reaches the scan."""
    return entries if path == "" else entries.where((F.col("path") == path) | F.col("path").startswith(path + "/"))


def readdir(entries: DataFrame, path: str = "") -> DataFrame:
    """name, kind, mode, size of the children of a directory, by name."""
    return tree(_at_or_below(entries, path)).where(F.col("parent") == path).select("name", "kind", "mode", "size").orderBy("name")


def getattr_(entries: DataFrame, path: str) -> DataFrame:
    return tree(_at_or_below(entries, path)).where(F.col("path") == path).select("path", "kind", "mode", "size", "mtime_secs", "target")


def readlink(entries: DataFrame, path: str) -> DataFrame:
    return entries.where((F.col("path") == path) & (F.col("kind") == "symlink")).select("target")


def statfs(entries: DataFrame) -> DataFrame:
    files = entries.where("kind = 'file'")
    return files.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"), F.count("*").alias("files"))


def lookup_file(entries: DataFrame, path: str) -> DataFrame:
    """The one file entry at a path; raises if there is none, or another kind, or several."""
    found = entries.where(F.col("path") == paths.lookup_path(path))
    kinds = [r.kind for r in found.select("kind").limit(2).collect()]
    if kinds != ["file"]:
        raise InvalidPath(f"{path!r}: {'not found' if not kinds else 'several entries' if len(kinds) > 1 else 'a ' + kinds[0]}")
    return found


def refs_in_scope(entries: DataFrame, scope: PathFilter = PathFilter(), single_blob: bool = False) -> DataFrame:
    """Chunk references of the files in scope; a single-blob listing takes no scope."""
    if single_blob and not scope.empty:
        raise CairnError("a path scope needs a directory listing")
    return chunk_refs(entries.where((F.col("kind") == "file") & scope.allows(F.col("path"))))


def union_refs(listings: list[DataFrame]) -> DataFrame:
    """The distinct chunk ids of all listings; partial aggregation leaves a row per id and task before the shuffle."""
    ids = [chunk_refs(e).select("chunk_id") for e in listings]
    out = ids[0]
    for x in ids[1:]:
        out = out.unionByName(x)
    return out.distinct()


def violations(entries: DataFrame, format_version: int = 2) -> DataFrame:
    """(path, fault) for whatever a listing must not hold; no rows: valid. Chunk tables are checked inside their row."""
    size, ends = F.col("size"), F.transform("chunks", lambda c: c["end_offset"])
    n = F.coalesce(F.size("chunks"), F.lit(0))
    pairs = F.when(n > 1, F.arrays_zip(F.slice(ends, 1, n - 1).alias("a"), F.slice(ends, 2, n - 1).alias("b")))
    file = F.col("kind") == "file"
    faults = F.array_compact(F.array(
        F.concat(F.lit("path: "), paths.path_fault(F.col("path"))),
        F.when(file & (size == 0) & (n > 0), "chunks in an empty file"),
        F.when(file & (size > 0) & (n == 0), "no chunks"),
        F.when(file & (n > 0) & ((ends[0] <= 0) | F.coalesce(F.exists(pairs, lambda p: p["b"] <= p["a"]), F.lit(False))), "end offsets don't increase"),
        F.when(file & (n > 0) & (F.element_at(ends, -1) != size), "last end differs from size"),
        F.when((F.col("kind") == "symlink") & (F.coalesce(F.col("target"), F.lit("")) == ""), "empty target"),
        F.when((F.col("kind") == "symlink") & F.lit(format_version < 2), "symlink in version 1"),
        F.when((F.col("kind") == "symlink") & (F.octet_length("target") > paths.MOST_BYTES), "target too long"),
    ))
    own = entries.select("path", F.explode(faults).alias("fault"))
    twice = entries.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("duplicate path").alias("fault"))
    return own.unionByName(twice)


def first_rows(rows: DataFrame, group: str, most: int) -> DataFrame:
    """The first rows of each group by path, with the group's total (`... and N more`)."""
    at = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("path"))).where(F.col("rank") <= most)
    return at.join(F.broadcast(rows.groupBy(group).agg(F.count("*").alias("total"))), group)  # a row per category

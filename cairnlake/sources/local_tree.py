"""Trees on a file system that all executors mount: names and attributes from one walk, contents by the tasks that need them."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.paths import check_path
from ..schema import BLOBS

_INVENTORY = "path string, kind string, mode long, size long, mtime_secs long, target string"


def walk(root: str, symlinks: str = "skip", empty_dirs: bool = False) -> tuple[list[tuple], dict[str, int]]:
    """(rows of path, kind, mode, size, mtime_secs, target; counts of skipped_symlinks and skipped_special), by path.

    Regular files; symlinks, never followed, if symlinks is "record"; directories without any entry if empty_dirs."""
    rows: list[tuple] = []
    skipped = {"skipped_symlinks": 0, "skipped_special": 0}
    pending = [""]
    while pending:
        at = pending.pop()
        with os.scandir(os.path.join(root, at) if at else root) as found:
            inside = sorted(found, key=lambda e: e.name)
        if at and not inside and empty_dirs:
            rows.append((at, "dir", os.lstat(os.path.join(root, at)).st_mode, None, None, None))
        for e in inside:
            path = f"{at}/{e.name}" if at else e.name
            info = e.stat(follow_symlinks=False)
            mtime = max(0, int(info.st_mtime // 1))
            if stat.S_ISLNK(info.st_mode):
                target = os.readlink(e.path)
                if symlinks == "record":
                    if not target or target.startswith("/"):
                        raise ValueError(f"{path}: symlink to {target!r}")
                    rows.append((check_path(path), "symlink", info.st_mode, None, None, target))
                else:
                    skipped["skipped_symlinks"] += 1
            elif stat.S_ISDIR(info.st_mode):
                pending.append(path)
            elif stat.S_ISREG(info.st_mode):
                rows.append((check_path(path), "file", info.st_mode, info.st_size, mtime, None))
            else:
                skipped["skipped_special"] += 1
    return sorted(rows), skipped


def inventory(spark: SparkSession, root: str, **how) -> DataFrame:
    return spark.createDataFrame(walk(root, **how)[0], _INVENTORY)


def with_content(inventory_: DataFrame, root: str) -> DataFrame:
    """The inventory with the files' bytes, read where the rows are; one file is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                data = None
                if r["kind"] == "file":
                    with open(os.path.join(root, r["path"]), "rb") as f:
                        data = f.read()
                yield pa.RecordBatch.from_pylist([r | {"content": data}], schema=schema)

    schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("mode", pa.int64()), ("size", pa.int64()), ("mtime_secs", pa.int64()), ("target", pa.string()), ("content", pa.binary())])
    return inventory_.mapInArrow(run, BLOBS)

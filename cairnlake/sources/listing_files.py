"""Listing files: the `.cfidx` (one blob) and `.cfdir` (tree) formats, as bytes, as DataFrames and as Spark data sources.

All integers are little-endian; both end in the BLAKE3 of all bytes before. Versions: the last magic byte is the major one, which
must be equal; a cfdir is written as version 2 only if it holds a symlink.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import blake3
from ..functions.batches import bounded
from ..functions.paths import check_path
from ..schema import ENTRIES, BadMagic, ChunkParams, InvalidStructure, TrailerMismatch, Truncated, UnsupportedFormatVersion, UnsupportedMajor
from . import fs

#: Fixed values of the formats.
INDEX_MAGIC = b"CFIDX\0\0\x01"
DIR_MAGIC = b"CFDIR\0\0\x01"
FILE, DIR, SYMLINK = 1, 2, 3
_INDEX_HEAD = struct.Struct("<8sHHIQQQQQ32s")
_DIR_HEAD = struct.Struct("<8sHHIQ")
_MOST = (1 << 63) - 1
#: Bytes of a piece of a cfdir in a table; an entry isn't split, so a piece may be longer by one.
PIECE = 1 << 20


def kind_of(data: bytes) -> str:
    """`cfidx` or `cfdir`, by the magic alone."""
    for magic, kind in ((INDEX_MAGIC, "cfidx"), (DIR_MAGIC, "cfdir")):
        if data[:7] == magic[:7]:
            if data[7:8] != magic[7:8]:
                raise UnsupportedMajor(f"{kind}: major version {data[7:8].hex()}")
            return kind
    raise BadMagic(data[:8].hex())


def check_chunks(size: int, chunks: list[tuple[int, str]]) -> None:
    """Chunks are empty exactly if the blob is; ends ascend, and the last is the size."""
    if bool(chunks) != bool(size):
        raise InvalidStructure(f"{len(chunks)} chunks for {size} bytes")
    before = 0
    for end, _ in chunks:
        if end <= before:
            raise InvalidStructure(f"end offset {end} after {before}")
        before = end
    if before != size:
        raise InvalidStructure(f"last end {before}, size {size}")


def _sealed(body: bytes) -> bytes:
    return body + blake3.digest(body)


def _opened(data: bytes, kind: str, head: int) -> bytes:
    if len(data) < head + 32:
        raise Truncated(f"{kind}: {len(data)} bytes")
    if kind_of(data) != kind:
        raise BadMagic(f"not a {kind}")
    return data


def _seal_holds(data: bytes) -> None:
    if blake3.digest(data[:-32]) != data[-32:]:
        raise TrailerMismatch("trailer checksum differs")


def _table(chunks: list[tuple[int, str]]) -> bytes:
    return b"".join(struct.pack("<Q", end) + bytes.fromhex(cid) for end, cid in chunks)


def encode_index(size: int, blob_id: str, chunks: list[tuple[int, str]], params: ChunkParams = ChunkParams(), flags: int = 0) -> bytes:
    return _sealed(_index_body(size, blob_id, chunks, params, flags))


def encode_indexes(blobs: list[tuple[int, str, list[tuple[int, str]]]], params: ChunkParams = ChunkParams(), flags: int = 0) -> list[bytes]:
    """The cfidx of each (size, blob_id, chunks); many small ones are hashed together."""
    bodies = [_index_body(*x, params, flags) for x in blobs]
    return [b + h for b, h in zip(bodies, _digests(bodies), strict=True)]


def _digests(bodies: list[bytes]) -> Iterator[bytes]:
    """Hashes of bodies, of about PIECE bytes at a time."""
    held, size = [], 0
    for b in bodies:
        held.append(b)
        size += max(len(b), blake3.LEAF)
        if size >= PIECE:
            yield from blake3.digests(held)
            held, size = [], 0
    yield from blake3.digests(held)


def _index_body(size: int, blob_id: str, chunks: list[tuple[int, str]], params: ChunkParams, flags: int) -> bytes:
    check_chunks(size, chunks)
    return _INDEX_HEAD.pack(INDEX_MAGIC, 1, flags, 0, params.min, params.avg, params.max, size, len(chunks), bytes.fromhex(blob_id)) + _table(chunks)


def decode_index(data: bytes) -> dict:
    """size, blob_id, chunks [(end_offset, id)], params, flags."""
    return decode_indexes([data])[0]


def decode_indexes(datas: list[bytes]) -> list[dict]:
    """decode_index of each; many small ones are hashed together."""
    for data in datas:
        _index_opened(data)
    for data, seal in zip(datas, _digests([d[:-32] for d in datas]), strict=True):
        if seal != data[-32:]:
            raise TrailerMismatch("trailer checksum differs")
    return [_index_of(data) for data in datas]


def _index_opened(data: bytes) -> None:
    _opened(data, "cfidx", _INDEX_HEAD.size)
    version, count = (_INDEX_HEAD.unpack_from(data)[k] for k in (1, 8))
    if version != 1:
        raise UnsupportedFormatVersion(f"cfidx: {version}")
    if len(data) != _INDEX_HEAD.size + 40 * count + 32:
        raise Truncated(f"cfidx: {len(data)} bytes for {count} chunks")


def _index_of(data: bytes) -> dict:
    _, _, flags, _, least, avg, most, size, count, blob = _INDEX_HEAD.unpack_from(data)
    try:
        params = ChunkParams(least, avg, most)
    except ValueError as e:
        raise InvalidStructure(str(e)) from e
    chunks = _chunks(data, _INDEX_HEAD.size, count)
    if size > _MOST:
        raise InvalidStructure(f"size {size}")
    check_chunks(size, chunks)
    return {"size": size, "blob_id": blob.hex(), "chunks": chunks, "params": params, "flags": flags}


def _chunks(data: bytes, at: int, count: int) -> list[tuple[int, str]]:
    return [(struct.unpack_from("<Q", data, at + 40 * k)[0], data[at + 40 * k + 8 : at + 40 * k + 40].hex()) for k in range(count)]


def _text(s: str, what: str) -> bytes:
    b = s.encode()
    if not b or len(b) > 65_535:
        raise InvalidStructure(f"{what} of {len(b)} bytes")
    return struct.pack("<H", len(b)) + b


def encode_entries(entries: Iterator[Row], flags: int = 0) -> bytes:
    """The cfdir of entries, in their order."""
    parts, version, seen = [], 1, set()
    for r in entries:
        if r["path"] in seen:
            raise InvalidStructure(f"duplicate path {r['path']!r}")
        seen.add(r["path"])
        parts.append(_entry(r))
        version = max(version, _version(r))
    return _sealed(_DIR_HEAD.pack(DIR_MAGIC, version, flags, 0, len(parts)) + b"".join(parts))


def _version(r: Row | dict) -> int:
    return 1 if r["kind"] in ("file", "dir") else 2


def _entry(r: Row | dict) -> bytes:
    check_path(r["path"])
    path = _text(r["path"], "path")
    if r["kind"] == "file":
        chunks = [(c["end_offset"], c["chunk_id"]) for c in r["chunks"] or ()]
        check_chunks(r["size"], chunks)
        return path + struct.pack("<BIQQ", FILE, r["mode"], r["size"], max(r["mtime_secs"] or 0, 0)) + bytes.fromhex(r["blob_id"]) + struct.pack("<Q", len(chunks)) + _table(chunks)
    if r["kind"] == "dir":
        return path + struct.pack("<BI", DIR, r["mode"])
    return path + struct.pack("<BI", SYMLINK, r["mode"]) + _text(r["target"] or "", "target")


def decode_dir(data: bytes) -> Iterator[dict]:
    """The entries of a cfdir, as ENTRIES rows."""
    _opened(data, "cfdir", _DIR_HEAD.size)
    _, version, _, _, count = _DIR_HEAD.unpack_from(data)
    if version not in (1, 2):
        raise UnsupportedFormatVersion(f"cfdir: {version}")
    _seal_holds(data)
    end, at, seen, n = len(data) - 32, _DIR_HEAD.size, set(), 0
    for row, at in itertools.islice(_decoded(data, at, end, version), count):
        if row["path"] in seen:
            raise InvalidStructure(f"duplicate path {row['path']!r}")
        seen.add(row["path"])
        n += 1
        yield row
    if n < count:
        raise Truncated(f"cfdir: at byte {at}")
    if at != end:
        raise InvalidStructure(f"{end - at} bytes left over")


def _decoded(data: bytes, at: int, end: int, version: int) -> Iterator[tuple[dict, int]]:
    """The entries of data[at:end], each with the place after it."""

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > end:
            raise Truncated(f"cfdir: at byte {at}")
        at += n
        return data[at - n : at]

    def text() -> str:
        try:
            return take(struct.unpack("<H", take(2))[0]).decode()
        except UnicodeDecodeError as e:
            raise InvalidStructure("text isn't UTF-8") from e

    while at < end:
        row = dict.fromkeys(ENTRIES.names)
        row["path"] = check_path(text())
        tag, row["mode"] = struct.unpack("<BI", take(5))
        if tag == FILE:
            size, mtime = struct.unpack("<QQ", take(16))
            blob = take(32).hex()
            n = struct.unpack("<Q", take(8))[0]
            if n > (end - at) // 40 or size > _MOST or mtime > _MOST:
                raise Truncated(f"cfdir: {n} chunks") if n > (end - at) // 40 else InvalidStructure("number out of range")
            chunks = _chunks(take(40 * n), 0, n)
            check_chunks(size, chunks)
            row |= {"kind": "file", "size": size, "mtime_secs": mtime, "blob_id": blob, "chunks": [{"end_offset": e, "chunk_id": c} for e, c in chunks]}
        elif tag == DIR:
            row["kind"] = "dir"
        elif tag == SYMLINK and version >= 2:
            row |= {"kind": "symlink", "target": text()}
            if not row["target"]:
                raise InvalidStructure("empty target")
        else:
            raise InvalidStructure(f"entry kind {tag} in version {version}")
        yield row, at


def _head(data: bytes) -> tuple:
    return _DIR_HEAD.unpack_from(data)


def _entry_end(data: bytes, at: int, end: int) -> int | None:
    """Where the entry at a place ends, without a look into it; None if that is beyond `end`."""
    if at + 2 > end:
        return None
    at += 2 + struct.unpack_from("<H", data, at)[0]
    if at + 5 > end:
        return None
    tag, at = data[at], at + 5
    if tag == FILE:
        if at + 56 > end:
            return None
        at += 56 + 40 * struct.unpack_from("<Q", data, at + 48)[0]
    elif tag == SYMLINK:
        if at + 2 > end:
            return None
        at += 2 + struct.unpack_from("<H", data, at)[0]
    elif tag != DIR:
        raise InvalidStructure(f"entry kind {tag}")
    return at if at <= end else None


_PIECES = "ord long, n long, version int, data binary"


def encode_pieces(entries: DataFrame, flags: int = 0) -> DataFrame:
    """(ord, data): the same bytes as encode_dir, in pieces in the shared scratch folder. Executors encode the entries, ranges of paths
    at once; one of them then reads the pieces in order for the trailer; the driver gets counts and the hash."""
    import pyarrow as pa
    from pyspark import TaskContext

    schema = pa.schema([("ord", pa.int64()), ("n", pa.int64()), ("version", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ord_, before, held, size, version = (TaskContext.get().partitionId() + 1) << 32, None, [], 0, 1

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"ord": ord_, "n": len(held), "version": version, "data": b"".join(held)}], schema=schema)

        for b in batches:
            for r in b.to_pylist():
                if r["path"] == before:  # equal paths lie in one range, side by side
                    raise InvalidStructure(f"duplicate path {before!r}")
                before = r["path"]
                held.append(_entry(r))
                version = max(version, _version(r))
                size += len(held[-1])
                if size >= PIECE:
                    yield out()
                    ord_, held, size = ord_ + 1, [], 0
        if held:
            yield out()

    spark = entries.sparkSession
    sorted_ = bounded(entries).select(*ENTRIES.names).repartitionByRange("path").sortWithinPartitions("path")
    pieces = fs.kept(sorted_.mapInArrow(run, _PIECES))
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("version"), F.lit(1)).alias("version")).first()
    head = _DIR_HEAD.pack(DIR_MAGIC, total.version, flags, 0, total.n)

    def seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = blake3.Hasher()
        h.update(head)
        for b in batches:
            for x in b.column("data"):
                h.update(x.as_py())
        yield pa.RecordBatch.from_pydict({"seal": [h.hexdigest()]})

    seals = _in_order(pieces).mapInArrow(seal, "seal string").collect()  # a row, or none where there are no entries
    ends = [(0, head), (_MOST, bytes.fromhex(seals[0].seal) if seals else blake3.digest(head))]
    return pieces.select("ord", "data").unionByName(spark.createDataFrame(ends, "ord long, data binary"))


def _in_order(pieces: DataFrame) -> DataFrame:
    """All pieces in one task, by their number; it streams them, so they needn't fit its memory."""
    return pieces.select("ord", "data").repartition(1).sortWithinPartitions("ord")


def decode_pieces(pieces: DataFrame) -> DataFrame:
    """The entries of a cfdir in pieces (ord, data), cut anywhere. One task finds where entries end and checks the trailer; all decode.

    Faults are the same as of decode_dir, in the text of the error of the task that finds them."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    if pieces.isEmpty():
        raise Truncated("cfdir: 0 bytes")
    size = _DIR_HEAD.size
    blocks_of = pa.schema([("ord", pa.int64()), ("n", pa.int64()), ("version", pa.int32()), ("data", pa.binary())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, h, head, found, ord_ = bytearray(), blake3.Hasher(), None, 0, 0
        for b in batches:
            for cell in b.column("data"):
                held += cell.as_py()
                if head is None:
                    if len(held) < size + 32:
                        continue
                    if kind_of(bytes(held[:8])) != "cfdir":
                        raise BadMagic("not a cfdir")
                    head = _head(held)
                    if head[1] not in (1, 2):
                        raise UnsupportedFormatVersion(f"cfdir: {head[1]}")
                    h.update(bytes(held[:size]))
                    del held[:size]
                n, at, end = 0, 0, len(held) - 32  # the last bytes may be the trailer
                while found + n < head[4] and (after := _entry_end(held, at, end)) is not None:
                    n, at = n + 1, after
                if n:
                    block = bytes(held[:at])
                    h.update(block)
                    del held[:at]
                    yield pa.RecordBatch.from_pylist([{"ord": ord_, "n": n, "version": head[1], "data": block}], schema=blocks_of)
                    found, ord_ = found + n, ord_ + 1
        if head is None:
            raise Truncated(f"cfdir: {len(held)} bytes")
        h.update(bytes(held[:-32]))
        if bytes.fromhex(h.hexdigest()) != held[-32:]:
            raise TrailerMismatch("trailer checksum differs")
        if found < head[4]:
            raise Truncated(f"cfdir: {found} of {head[4]} entries")
        if len(held) > 32:
            raise InvalidStructure(f"{len(held) - 32} bytes left over")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rows = [row for row, _ in _decoded(r["data"], 0, len(r["data"]), r["version"])]
                yield pa.RecordBatch.from_pylist(rows, schema=entries_of)

    entries_of = to_arrow_schema(ENTRIES)
    blocks = fs.kept(_in_order(bounded(pieces)).mapInArrow(split, _PIECES))
    back = fs.kept(blocks.repartition(_tasks(pieces.sparkSession)).mapInArrow(decode, ENTRIES))
    for twice in back.groupBy("path").count().where("count > 1").limit(1).collect():
        raise InvalidStructure(f"duplicate path {twice.path!r}")
    return back


def _tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def encode_dir(entries: DataFrame, flags: int = 0) -> bytes:
    """The cfdir of a listing, by path; rows come to the driver one partition at a time, as the format has one trailer."""
    return encode_entries(entries.orderBy("path").toLocalIterator(), flags)


def write_dir(entries: DataFrame, path: str, force: bool = False) -> int:
    """Writes a cfdir at once under its name; refuses to replace a file without force. Bytes written."""
    import os

    if os.path.lexists(path) and not force:
        raise FileExistsError(path)
    data = encode_dir(entries)
    with open(path + ".part", "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(path + ".part", path)
    return len(data)


def _rows(data: bytes, name: str) -> Iterator[tuple]:
    if kind_of(data) == "cfdir":
        for r in decode_dir(data):
            yield tuple(r[c] if c != "chunks" or r[c] is None else [(x["end_offset"], x["chunk_id"]) for x in r[c]] for c in ENTRIES.names)
    else:
        x = decode_index(data)
        stem = name.rsplit("/", 1)[-1].removesuffix(".cfidx")
        yield stem, "file", 0, x["size"], 0, x["blob_id"], None, x["chunks"]


def decode_dir_frame(spark: SparkSession, data: bytes) -> DataFrame:
    return spark.createDataFrame(list(_rows(data, "")), ENTRIES)


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all listing files that a path or pattern names, with listing_id (the file), decoded by the executors that read them."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = [dict(zip(ENTRIES.names, r, strict=True)) | {"listing_id": name} for r in _rows(data, name)]
                for r in rows:
                    r["chunks"] = r["chunks"] and [{"end_offset": e, "chunk_id": c} for e, c in r["chunks"]]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructType

    out = StructType([*ENTRIES.fields]).add("listing_id", StringType())
    schema = to_arrow_schema(out)
    return files.mapInArrow(run, out)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import glob

        return [_File(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from _rows(f.read(), partition.path)


class ListingSource(DataSource):
    """spark.read.format("cflisting").load(path): entries of listing files on a folder that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "cflisting"

    def schema(self):
        return ENTRIES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ListingSource)



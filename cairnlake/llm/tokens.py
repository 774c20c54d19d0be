"""Token ids of a corpus as rANS-coded block files, written and read back in parallel.

encode_corpus tokenises every whole text (null: empty) with a tokenizers file, appends an end id, orders documents by doc_id
(null ids first; equal ids by text) or as rows stand in their files, and writes blocks of whole documents, about BLOCK tokens each, coded with one frequency
table counted over the whole corpus. The folder holds `blocks` (shard, block, place: ids before it in its shard, tokens, image:
see rans.py), `shards` (shard, start: ids before it) and `table` (symbol, freq); a block decodes without any other, so a reader
starts at every block. decode_corpus reads them back and checks every checksum.

The ids of a word between ASCII white space don't depend on its neighbours as long as the tokenizer's pieces hold no white space,
so each worker keeps the ids of words it has met; `whole=True` encodes whole texts instead (tokenizers whose pieces may).

Cases: an empty text is its end id alone; an empty table writes no blocks; rows that repeat are separate documents; extra columns
are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, discard, flat, hold, id_text, new_folder, release, shards, span_hash, trim, written
from .common import words as split_words
from .rans import Codec, image, parsed, quantised

BLOCK = 1 << 16
#: Words whose ids a worker keeps, and places of its table (24 bytes each).
KEPT_WORDS, SLOTS = 1_400_000, 1 << 21
#: Text bytes that are split into words at once.
PART = 2 << 20
_BLOCKS = "shard long, block long, place long, tokens long, image binary"


#: Words stand between ASCII white space; bytes are as they are (NUL stands as 255, which UTF-8 never has).
_RAW = np.arange(256, dtype=np.uint8)
_RAW[[9, 10, 11, 12, 13, 32]] = 0
_RAW[0] = 255


class _Words:
    """Ids of words by 64-bit hash in one open-addressed table of SLOTS places; it begins anew when KEPT_WORDS are in it."""

    def __init__(self, kind: np.dtype):
        self.kind = kind
        self.keys = np.zeros(SLOTS, np.uint64)
        self.checks = np.zeros(SLOTS, np.uint64)
        self.starts = np.zeros(SLOTS, np.uint32)
        self.sizes = np.zeros(SLOTS, np.uint32)
        self.pool = np.zeros(1 << 16, kind)
        self.used = self.words = 0

    def forget(self) -> None:
        self.keys[:] = 0
        self.used = self.words = 0

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it isn't there. No key is 0."""
        at = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        live = np.arange(len(keys))
        out = np.full(len(keys), -1)
        while len(live):
            there = self.keys[at[live]]
            hit = there == keys[live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit & (there != 0)]
            at[live] = (at[live] + 1) & (SLOTS - 1)
        return out

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Distinct keys that aren't there yet."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(ids), len(self.pool)), self.kind)])
        self.pool[self.used : self.used + len(ids)] = ids
        starts = self.used + np.cumsum(sizes) - sizes
        self.used, self.words = self.used + len(ids), self.words + len(keys)
        at = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        live = np.arange(len(keys))
        while len(live):
            free = live[self.keys[at[live]] == 0]
            self.keys[at[free]] = keys[free]  # of several that want one place, one gets it
            mine = free[self.keys[at[free]] == keys[free]]
            self.checks[at[mine]], self.starts[at[mine]], self.sizes[at[mine]] = checks[mine], starts[mine], sizes[mine]
            live = live[self.keys[at[live]] != keys[live]]
            at[live] = (at[live] + 1) & (SLOTS - 1)


#: Where a tokenizer whose pieces hold white space would give other ids than word by word.
_SAMPLE = "One two,  three\tfour\n\nfive  six. A b \u00e9t\u00e9 x1 2 345 \u4e00\u4e8c \U0001f600 end"


class _Encoder:
    """One worker's tokenizer and the ids of words it has met."""

    made: dict[tuple[str, bool], _Encoder] = {}

    def __init__(self, path: str, whole: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.whole = Tokenizer.from_file(path), whole
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        if whole:
            return
        apart = [i for w in _SAMPLE.split() for i in self.tokenizer.encode(w, add_special_tokens=False).ids]
        if self.tokenizer.encode(_SAMPLE, add_special_tokens=False).ids != apart:
            raise ValueError("this tokenizer's ids of a word depend on the white space beside it: use whole=True")
        self.known = _Words(self.kind)

    @classmethod
    def of(cls, path: str, whole: bool) -> _Encoder:
        if (path, whole) not in cls.made:
            cls.made[path, whole] = cls(path, whole)
            hold("tokens", cls.made.clear)
        return cls.made[path, whole]

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, sizes): many are encoded at once with spaces between and told apart by their offsets."""
        ids, sizes = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for k in range(0, len(words), 250):
            group = words[k : k + 250]
            e = self.tokenizer.encode(" ".join(group), add_special_tokens=False)
            offsets = e.offsets
            at = np.fromiter((x for x, _ in offsets), np.int64, len(offsets))
            ends = np.cumsum([len(w) + 1 for w in group])
            ids.append(np.array(e.ids, self.kind))
            sizes.append(np.diff(np.searchsorted(at, ends), prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.kind) for t in texts]
        return np.concatenate([np.zeros(0, self.kind), *each]), np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, bounds): the ids of row r are symbols[bounds[r]:bounds[r + 1]]. A long text is encoded in parts that white space ends."""
        col = pc.fill_null(col, "")
        if self.whole:
            return self._whole(col.to_pylist())
        buf, off = flat(col)
        if len(buf) <= 2 * PART:
            return self._part(buf, off)
        symbols, sizes = [np.zeros(0, self.kind)], np.zeros(len(off) - 1, np.int64)
        for r, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            while a < b:
                to = min(b, a + PART)
                while to < b:  # the next white space
                    space = np.flatnonzero(_RAW[buf[to : min(b, to + 4096)]] == 0)
                    if len(space):
                        to += int(space[0])
                        break
                    to = min(b, to + 4096)
                part, _ = self._part(buf[a:to], np.array([0, to - a]))
                symbols.append(part)
                sizes[r] += len(part)
                a = to
        return np.concatenate(symbols), np.concatenate([[0], np.cumsum(sizes)])

    def _part(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, starts, ends, first = split_words(buf, off, _RAW)
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(off), np.int64)
        keys, checks = span_hash(low, starts, ends, check=True)
        keys[keys == 0] = 1
        known = self.known
        at = known.slots(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            new = new[np.unique(keys[new], return_index=True)[1]]
            if known.words + len(new) > KEPT_WORDS:
                known.forget()
                new = np.unique(keys, return_index=True)[1]
            if len(new) > KEPT_WORDS:  # more words at once than are kept
                return self._each(buf, off)
            data = buf.tobytes()
            ids, sizes = self._ids([data[x:y].decode("utf-8", "replace") for x, y in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            known.add(keys[new], checks[new], ids, sizes)
            at = known.slots(keys)
        if (known.checks[at] != checks).any():  # two words share a hash
            return self._each(buf, off)
        sizes = known.sizes[at].astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        symbols = known.pool[np.repeat(known.starts[at].astype(np.int64) - cuts[:-1], sizes) + np.arange(cuts[-1])]
        return symbols, cuts[first]

    def _each(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = buf.tobytes()
        return self._whole([data[x:y].decode("utf-8", "replace") for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])


_TOKENS = "shard long, block long, place long, tokens long, counts array<long>, ids array<long>, symbols binary"


def _in_order(docs: DataFrame, order: str) -> DataFrame:
    """doc_id and text, range-partitioned and sorted: by doc_id, or as the rows of the Parquet files that docs reads follow each other."""
    if order == "id":
        return id_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    where = bounded(docs).select("doc_id", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return id_text(where.repartitionByRange("_file", "_row").sortWithinPartitions("_file", "_row"))


def tokenised(docs: DataFrame, path: str, end_id: int, whole: bool = False, block: int = BLOCK, order: str = "id") -> DataFrame:
    """Blocks of documents in order: shard, block, place (ids before it in the shard), tokens, counts, ids, symbols."""

    schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("place", pa.int64()), ("tokens", pa.int64()), ("counts", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("symbols", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _Encoder.of(path, whole), TaskContext.get().partitionId()
        place = number = 0
        left = np.zeros(0, encoder.kind)
        left_counts: list[int] = []
        left_ids: list = []

        def made(n: int) -> pa.RecordBatch:
            """A block of the first n documents that are left."""
            nonlocal left, left_counts, left_ids, place, number
            size = sum(left_counts[:n])
            row = {"shard": shard, "block": number, "place": place, "tokens": size, "counts": left_counts[:n], "ids": left_ids[:n], "symbols": left[:size].tobytes()}
            left, left_counts, left_ids = left[size:], left_counts[n:], left_ids[n:]
            place, number = place + size, number + 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for b in shards(batches, most=PART, keep="tokens"):
            symbols, bounds = encoder.encode(b.column("text"))
            symbols = np.insert(symbols, bounds[1:], end_id)
            left = np.concatenate([left, symbols])
            left_counts += (np.diff(bounds) + 1).tolist()
            left_ids += b.column("doc_id").to_pylist()
            while True:
                full = np.flatnonzero(np.cumsum(left_counts) >= block)
                if not len(full):
                    break
                yield made(int(full[0]) + 1)
        if left_counts:
            yield made(len(left_counts))
        trim()

    return _in_order(docs, order).mapInArrow(run, _TOKENS)


def _symbols(data: bytes, tokens: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * tokens else "<u4")


def symbol_counts(tokens: DataFrame) -> DataFrame:
    """(symbol, n) over the whole corpus; at most one row per symbol and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros(0, np.int64)
        for b in batches:
            for n, data in zip(b.column("tokens").to_pylist(), b.column("symbols"), strict=True):
                now = np.bincount(_symbols(data.as_py(), n), minlength=len(total))
                now[: len(total)] += total
                total = now
        s = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(total[s], pa.int64())], names=["symbol", "n"])

    return tokens.select("tokens", "symbols").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def _groups(batch: pa.RecordBatch, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of blocks that hold about `most` tokens together (or one block)."""
    at, sums = 0, np.concatenate([[0], np.cumsum(batch.column("tokens").to_numpy())])
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sums, sums[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def encode_corpus(docs: DataFrame, folder: str, path: str, end_id: int, whole: bool = False, block: int = BLOCK, order: str = "id") -> str:
    """Writes blocks, shards and table to the folder (which Spark can write to) and returns it. order: "id", or "rows" of Parquet files."""
    spark = docs.sparkSession
    tokens = written(tokenised(docs, path, end_id, whole, block, order))
    seen = symbol_counts(tokens).collect()  # as many rows as the vocabulary has ids, at most
    counts = np.zeros(max([r.symbol for r in seen], default=0) + 1, np.int64)
    for r in seen:
        counts[r.symbol] = r.n
    freq, bits = quantised(counts)
    codec = spark.sparkContext.broadcast((freq, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        coder = Codec(*codec.value)
        for batch in batches:
            for b in _groups(batch):
                n = b.column("tokens").to_pylist()
                coded = coder.encode([_symbols(x.as_py(), k) for k, x in zip(n, b.column("symbols"), strict=True)])
                images = []
                for pieces, c, i in zip(coded, b.column("counts"), b.column("ids"), strict=True):
                    ids = i.values
                    images.append(image(pieces, c.values.to_numpy(), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("block"), b.column("place"), b.column("tokens"), pa.array(images, pa.binary())], names=["shard", "block", "place", "tokens", "image"])

    tokens.mapInArrow(run, _BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    sums = tokens.groupBy("shard").agg(F.sum("tokens").alias("tokens"))  # one row per task that wrote
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    sums.select("shard", F.coalesce(before, F.lit(0)).alias("start")).write.parquet(f"{folder}/shards")
    spark.createDataFrame([(int(s), int(freq[s])) for s in np.flatnonzero(freq)], "symbol long, freq long").coalesce(1).write.parquet(f"{folder}/table")
    discard(spark, tokens)
    return folder


def decode_corpus(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids (uint32 little-endian; null if not asked for), ids_crc32."""
    rows = spark.read.parquet(f"{folder}/table").collect()  # one row per symbol
    freq = np.zeros(max(r.symbol for r in rows) + 1, np.int64)
    for r in rows:
        freq[r.symbol] = r.freq
    table = spark.sparkContext.broadcast((freq, int(freq.sum()).bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        coder = Codec(*table.value)
        for batch in batches:
            for b in _groups(batch):
                images = [parsed(x.as_py()) for x in b.column("image")]
                places, which = b.column("place").to_pylist(), b.column("shard").to_pylist()
                symbols = coder.decode([pieces for pieces, *_ in images])
                for (_, counts, doc, null), place, shard, got in zip(images, places, which, symbols, strict=True):
                    ends = np.cumsum(counts)
                    data = memoryview(got.astype("<u4", copy=False).tobytes())
                    each = [data[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc, pa.int64(), mask=null.astype(bool)), pa.array(np.full(len(doc), shard)), pa.array(place + ends - counts), pa.array(counts), pa.array([bytes(x) if ids else None for x in each], pa.binary()), pa.array([zlib.crc32(x) for x in each], pa.int64())],
                        names=["doc_id", "shard", "start", "n_tokens", "ids", "ids_crc32"],
                    )

    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks").select("shard", "place", "tokens", "image")
    docs = blocks.mapInArrow(run, "doc_id long, shard long, start long, n_tokens long, ids binary, ids_crc32 long")
    before = spark.read.schema("shard long, start long").parquet(f"{folder}/shards").withColumnRenamed("start", "before")
    return docs.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids", "ids_crc32")


def round_trip(docs: DataFrame, path: str, end_id: int, whole: bool = False, ids: bool = True, order: str = "id") -> DataFrame:
    """decode_corpus(encode_corpus(docs)) through a new folder beside the other written tables."""
    folder = new_folder(docs.sparkSession, "tokens")
    return decode_corpus(docs.sparkSession, encode_corpus(docs, folder, path, end_id, whole, order=order), ids)

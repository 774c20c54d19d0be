"""Substring deduplication by sliding sentence spans.

Words stand between ASCII white space, A-Z lower-cased. A sentence ends after a word that ends in `.`, `!` or `?`, at a line end,
and, so that long and unpunctuated ones have ends too, after each word whose key (of its bytes' sum and number) is at most those of
the AROUND words on either side. Ends thus depend on a few neighbouring words only, whatever stands around a passage: sentences have
4 to 5 words on average, and of random words a passage of 51 holds no whole run with probability 2e-5, one of 60 below 1e-6. Every
run of RUN consecutive sentences is hashed (a shorter document is one run). Of equal runs, the one with the smallest (doc_id, place)
is the first; sentences that any other covers are removed.

Runs are counted by partial aggregation, so a run that stands in a third of all documents costs a row per task; to find the others
of its kind, runs that hold over 1/1000 of all rows (so fewer than 1000 of them) are broadcast and the rest is joined by hash.

Cases: null or wordless texts have no sentences and stay; an empty table gives an empty result; a word of any length is one word;
texts of any length are handled whole, alone if they exceed a shard; null ids come last; rows that share an id count as one document
(what repeats at the same place in both stays in both); extra columns, whatever their names, stay in `deduplicated`, and are ignored elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ODD, SPACED, U64, carried, discard, flat, id_text, mix, shards, span_hash, uncarried, words, written

RUN = 4
AROUND = 2
#: Text bytes hashed at once.
PART = 1 << 20
_LAST = (1 << 63) - 1


def word_keys(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """16 bits of each word: (40503 x the sum of its bytes + 10007 x their number) modulo 65536."""
    sums = np.add.reduceat(low, starts, dtype=np.uint32)  # bytes between words are 0
    return (sums * np.uint32(40503) + (ends - starts).astype(np.uint32) * np.uint32(10007)) & np.uint32(0xFFFF)


def sentences(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low, starts, ends, first, head, of): head: the first word of each sentence; the sentences of row r are of[r]:of[r + 1]."""
    buf, off = flat(col)
    low, starts, ends, first = words(buf, off, SPACED)
    if not len(starts):
        return low, starts, ends, first, np.zeros(0, np.int64), np.zeros(len(first), np.int64)
    key, row = word_keys(low, starts, ends), np.repeat(np.arange(len(first) - 1), np.diff(first))
    last = np.ones(len(starts), bool)
    for d in range(1, AROUND + 1):
        apart = row[d:] != row[:-d]
        last[d:] &= apart | (key[d:] <= key[:-d])
        last[:-d] &= apart | (key[:-d] <= key[d:])
    final = low[ends - 1]
    last |= (final == 46) | (final == 33) | (final == 63)
    lines = np.flatnonzero(buf == 10)
    if len(lines):
        last[:-1] |= np.searchsorted(lines, starts[1:]) > np.searchsorted(lines, ends[:-1])
    ending = first[1:] - 1
    last[ending[np.diff(first) > 0]] = True
    head = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    return low, starts, ends, first, head, np.searchsorted(head, first)


def _run_hashes(h: np.ndarray, head: np.ndarray, of: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, hash) of every run."""
    n = np.diff(of)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(head)) - of[:-1][row]
    keep = (place + run <= n[row]) | ((place == 0) & (n[row] < run))
    row, place = row[keep], place[keep]
    size = np.minimum(run, n[row])
    # a sentence's hash adds up those of its words, each mixed with its place
    size_of = np.diff(np.append(head, len(h)))
    inner = np.arange(len(h)) - np.repeat(head, size_of)
    sent = mix(np.add.reduceat(mix(h + (inner.astype(U64) + U64(1)) * ODD[40]), head) + size_of.astype(U64))
    at = of[:-1][row] + place
    total = size.astype(U64) * ODD[41]
    for j in range(run):
        part = sent[np.minimum(at + j, len(sent) - 1)] * ODD[j]
        total += np.where(j < size, part, U64(0))
    return row, place, mix(total)


def runs(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(hash, doc, place) of every run of every document."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shards(batches, most=PART):
            low, starts, ends, _, head, of = sentences(b.column("text"))
            if not len(starts):
                continue
            row, place, h = _run_hashes(span_hash(low, starts, ends), head, of, run)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("doc_id").fill_null(_LAST).take(pa.array(row)), pa.array(place, pa.int32())], names=["hash", "doc", "place"])

    return docs.mapInArrow(make, "hash long, doc long, place int")


def repeated(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(doc, places: of its runs that repeat an earlier one) for each document that has any."""
    every = written(runs(id_text(docs), run))
    total = every.count()
    firsts = written(every.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("doc", "place")).alias("first")).where("n > 1"))
    hot = firsts.where(F.col("n") * 1000 > total).drop("n")
    cold = firsts.where(F.col("n") * 1000 <= total).drop("n")
    some = every.join(cold, "hash")
    most = every.join(F.broadcast(hot), "hash")
    later = some.unionByName(most).where("not (doc = first.doc and place = first.place)")
    found = written(later.groupBy("doc").agg(F.array_sort(F.collect_set("place")).alias("places")))
    discard(docs.sparkSession, every, firsts)
    return found


def _cut(b: pa.RecordBatch, run: int) -> tuple[list[str], list[int], list[list[list[int]]], list[str]]:
    """Per row: the text left, the number of sentences, the removed [first, end) sentences, and a digest of the words left."""
    low, starts, ends, first, head, of = sentences(b.column("_text"))
    buf, off = flat(b.column("_text"))
    data, lowered = buf.tobytes(), low.tobytes()
    texts, counts, gone, digests = [], [], [], []
    for r, places in enumerate(b.column("_places").to_pylist()):
        n = int(of[r + 1] - of[r])
        drop = np.zeros(n + 1, bool)
        for p in places or ():
            drop[p : min(p + run, n)] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], drop[:n], [False]]).astype(np.int8)))
        heads = head[of[r] : of[r + 1]]
        bounds = [*starts[heads].tolist(), int(off[r + 1])]
        kept = [data[off[r] : bounds[0]], *(data[bounds[i] : bounds[i + 1]] for i in range(n) if not drop[i])]
        stay = np.repeat(~drop[:n], np.diff(np.append(heads, first[r + 1]))) if n else np.zeros(0, bool)
        left = (lowered[x:y] for x, y in zip(starts[first[r] : first[r + 1]][stay].tolist(), ends[first[r] : first[r + 1]][stay].tolist(), strict=True))
        digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
        texts.append(b"".join(kept).decode("utf-8", "replace"))
        counts.append(n)
        gone.append(edge.reshape(-1, 2).tolist())
    return texts, counts, gone, digests


def report(docs: DataFrame, run: int = RUN) -> DataFrame:
    """One row per row of docs: doc_id, text (what is left), n_sentences, n_removed, removed (ranges of sentences), kept_sha256 (of the words left, space-joined)."""
    places = repeated(docs, run).select(F.col("doc").alias("_doc"), F.col("places").alias("_places"))
    src = id_text(docs).select("doc_id", F.col("text").alias("_text"), F.coalesce("doc_id", F.lit(_LAST)).alias("_doc")).join(places, "_doc", "left").select("doc_id", "_text", "_places")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shards(batches, "_text"):
            texts, counts, gone, digests = _cut(b, run)
            removed = [sum(y - x for x, y in g) for g in gone]
            left = pc.if_else(b.column("_text").is_null(), pa.scalar(None, pa.string()), pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), left, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(gone, pa.list_(pa.list_(pa.int64()))), pa.array(digests, pa.string())],
                names=["doc_id", "text", "n_sentences", "n_removed", "removed", "kept_sha256"],
            )

    return src.mapInArrow(make, "doc_id long, text string, n_sentences long, n_removed long, removed array<array<long>>, kept_sha256 string")


def deduplicated(docs: DataFrame, run: int = RUN) -> DataFrame:
    """docs with the repeated sentences taken out of text; all columns stay."""
    places = repeated(docs, run).select(F.col("doc").alias("_doc"), F.col("places").alias("_places"))
    src = carried(docs, _text=F.col("text").cast("string"), _doc=F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)))
    src = src.join(places, "_doc", "left").select("_row", "_text", "_places")
    out = src.select("_row", F.col("_text").alias("_left")).schema

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shards(batches, "_text"):
            texts = pa.array(_cut(b, run)[0], pa.string())
            texts = pc.if_else(b.column("_text").is_null(), pa.scalar(None, pa.string()), texts)
            yield pa.RecordBatch.from_arrays([b.column("_row"), texts], names=["_row", "_left"])

    return uncarried(src.mapInArrow(make, out), docs.columns, text=F.col("_left"))

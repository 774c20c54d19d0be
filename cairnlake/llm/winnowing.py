"""Document fingerprints by winnowing.

Every K consecutive code points are hashed by a rolling polynomial; of every WINDOW consecutive hashes the least is chosen, the
rightmost of equal ones, and kept with its place. Two texts that share WINDOW + K - 1 code points share a chosen hash. A text of
fewer than K code points has one hash, of all of it; with fewer than WINDOW hashes the least of all is chosen; an empty or null
text has none. Likeness is the Jaccard similarity of two fingerprints' sets of hashes (1 if both are empty). Hashes have 31 bits.

Cases: a null text is empty; null ids come after all others in the order of documents; rows that repeat an id follow one another, by
text; an empty table gives an empty result; texts of any length are hashed whole, alone if they exceed a shard; extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, id_text, list_column, mix, ranges, shards

#: Texts that share K + WINDOW - 1 = 31 code points share a hash.
K = 12
WINDOW = 20
_BASE = 0x9E3779B97F4A7C15


def _grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of codes[i:i + k]: polynomial hashes of 2^j codes are joined in pairs."""
    n, out, done, size, at = len(codes), None, 0, 1, codes.astype(U64) + U64(1)
    while size <= k:
        if k & size:
            m = max(0, n - done - size + 1)
            out = at[:m] if out is None else out[:m] * U64(pow(_BASE, size, 1 << 64)) + at[done : done + m]
            done += size
        at = at[:-size] * U64(pow(_BASE, size, 1 << 64)) + at[size:] if len(at) > size else at[:0]
        size *= 2
    return out


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of every w consecutive values."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def fingerprints(texts: list[np.ndarray], k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, places, bounds): the chosen 31-bit hashes of text i, in order of place, are hashes[bounds[i]:bounds[i + 1]]. texts: code points."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))  # hashes of each text
    codes = np.concatenate(texts) if len(texts) else np.zeros(0, np.uint32)
    first = np.cumsum(sizes) - sizes
    big = _grams(codes, k) if len(codes) >= k else np.zeros(0, U64)
    # room for every text's hashes, padded to at least one window with values that never are the least
    room = np.where(n > 0, np.maximum(n, window), 0)
    begin = np.cumsum(room) - room
    total = int(room.sum())
    key = np.full(total, U64(0xFFFFFFFFFFFFFFFF))
    of = np.repeat(np.arange(len(texts)), n)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    h = np.zeros(len(of), U64)
    usual = sizes[of] >= k
    h[usual] = big[(first[of] + inner)[usual]]
    for i in np.flatnonzero((sizes > 0) & (sizes < k)).tolist():
        v = 0
        for c in texts[i].tolist():
            v = (v * _BASE + c + 1) & 0xFFFFFFFFFFFFFFFF
        h[np.searchsorted(of, i)] = v
    # the least hash, of equal ones the rightmost: places count down in the low half
    key[begin[of] + inner] = ((mix(h) >> U64(33)) << U64(32)) | (U64(0xFFFFFFFF) - inner.astype(U64))
    if total < window:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    best = _least(key, window)
    row = np.repeat(np.arange(len(texts)), room)[: len(best)]
    inside = np.arange(len(best)) + window <= (begin + room)[row]
    best, row = best[inside], row[inside]
    new = np.ones(len(best), bool)
    new[1:] = (best[1:] != best[:-1]) | (row[1:] != row[:-1])
    best, row = best[new], row[new]
    return (best >> U64(32)).astype(np.uint32), (U64(0xFFFFFFFF) - (best & U64(0xFFFFFFFF))).astype(np.int64), np.searchsorted(row, np.arange(len(texts) + 1))


def code_points(col: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in col.to_pylist()]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets of hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def winnow(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, hashes and places (code points) in order of place."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shards(batches):
            hashes, places, bounds = fingerprints(code_points(b.column("text")), k, window)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), list_column(hashes.astype(np.int64), bounds, pa.int64()), list_column(places, bounds, pa.int64())], names=["doc_id", "hashes", "places"])

    return id_text(docs).mapInArrow(make, "doc_id long, hashes array<long>, places array<long>")


def _bounds_above(bounds, n: int):
    """How many of n ascending bounds are greater than doc_id, by binary search."""
    steps = F.sequence(F.lit(1), F.lit(n.bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))  # bounds before lo are at most doc_id, those from hi on are greater

    def step(s, _):
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        more = F.element_at(bounds, F.least(mid, F.lit(n - 1)) + 1) > F.col("doc_id")
        stop = s["lo"] >= s["hi"]
        return F.struct(F.when(stop | more, s["lo"]).otherwise(mid + 1).alias("lo"), F.when(~stop & more, mid).otherwise(s["hi"]).alias("hi"))

    return F.lit(n) - F.aggregate(steps, start, step)["lo"]


def in_rows(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text, own) dealt into `parts` ranges of descending doc_id, each sorted; a range ends with a copy (own = false) of
    the document that follows its last, so that each task sees every document beside its successor. After the last comes the first.

    Bounds are approximate quantiles of doc_id; the first id of each range is a row per range on the driver.
    """
    src = id_text(docs)
    bounds = sorted(set(src.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    constant = lambda xs: F.from_json(F.lit(json.dumps(xs)), "array<long>")
    # range 0 holds the largest ids; null ids come after all
    range_ = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(F.lit(0) if not bounds else _bounds_above(constant([int(x) for x in bounds]), len(bounds)))
    heads = sorted(tuple(r) for r in src.select("doc_id", range_.cast("int").alias("r")).groupBy("r").agg(F.max("doc_id")).collect())
    # ranges without documents are left out
    number = {r: i for i, (r, _) in enumerate(heads)}
    of = F.element_at(constant([number.get(r, 0) for r in range(len(bounds) + 2)]), range_.cast("int") + 1).cast("int")
    head = F.element_at(constant([h for _, h in heads] or [None]), F.col("r") + 1)
    placed = src.withColumn("r", of).withColumn("first", F.col("doc_id").eqNullSafe(head))
    n = max(1, len(heads))
    copies = F.when(F.col("first"), F.array(F.struct(F.col("r").alias("p"), F.lit(True).alias("own")), F.struct(F.pmod(F.col("r") - 1, F.lit(n)).alias("p"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(F.col("r").alias("p"), F.lit(True).alias("own"))))
    dealt = placed.select("doc_id", "text", F.explode(copies).alias("x")).select("doc_id", "text", "x.p", "x.own")
    return dealt.repartitionById(n, F.col("p")).sortWithinPartitions(F.col("own").desc(), F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()).drop("p")


def compared(docs: DataFrame, parts: int | None = None, k: int = K, window: int = WINDOW) -> DataFrame:
    """Every document's fingerprint beside that of its edited text and of the next document (descending doc_id, null ids last,
    equal ids by text; after the last comes the first): doc_id, n_chars, edited, hashes, places, edited_hashes, near_edited, near_next.

    The edited text is the document with its last floor(n_chars / 2) code points replaced by the first as many of the next one's.
    One shuffle deals the documents out in order; each task then streams over its range.
    """
    parts = parts or ranges(docs)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last own document so far, whose successor is still to come
        done = False
        for b in shards(batches, rows=1024):
            ids, texts, own = b.column("doc_id").to_pylist(), code_points(b.column("text")), b.column("own").to_pylist()
            if held:
                ids, texts, own = [held[0], *ids], [held[1], *texts], [True, *own]
            cut = len(ids)
            if False in own:  # the copy of the next range's first ends this range; of equal ids the first in order counts
                cut = own.index(False) + 1
                done = done or cut > 1 or held is not None
            yield from _pairs(ids[:cut], texts[:cut], k, window)
            held = (ids[cut - 1], texts[cut - 1]) if own[cut - 1] else None
            if False in own:
                break
        if held:  # a lone range: its last document is followed by itself only if the copy is missing
            yield from _pairs([held[0], None], [held[1], np.zeros(0, np.uint32)], k, window)

    return in_rows(docs, parts).mapInArrow(make, "doc_id long, n_chars long, edited string, hashes array<long>, places array<long>, edited_hashes array<long>, near_edited double, near_next double")


def _pairs(ids: list, texts: list[np.ndarray], k: int, window: int) -> Iterator[pa.RecordBatch]:
    """A row for each document but the last, which only follows."""
    if len(ids) < 2:
        return
    edited = [np.concatenate([t[: len(t) - len(t) // 2], n[: len(t) // 2]]) for t, n in zip(texts[:-1], texts[1:], strict=True)]
    hashes, places, bounds = fingerprints(texts, k, window)
    e_hashes, _, e_bounds = fingerprints(edited, k, window)
    sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    e_sets = [np.unique(e_hashes[a:b]) for a, b in zip(e_bounds[:-1].tolist(), e_bounds[1:].tolist(), strict=True)]
    m = len(edited)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([t.tobytes().decode("utf-32-le", "replace") for t in edited], pa.string()),
            list_column(hashes[: bounds[m]].astype(np.int64), bounds[: m + 1], pa.int64()), list_column(places[: bounds[m]], bounds[: m + 1], pa.int64()), list_column(e_hashes.astype(np.int64), e_bounds, pa.int64()),
            pa.array([likeness(a, b) for a, b in zip(sets[:-1], e_sets, strict=True)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(sets[:-1], sets[1:], strict=True)], pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited", "hashes", "places", "edited_hashes", "near_edited", "near_next"],
    )

"""MinHash near-deduplication: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

A document's set is its distinct 5-word shingles (words: `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; fewer words: the whole
sequence; none: the empty set, linked with nothing). Two documents are linked if 100 * |A and B| >= percent * |A or B|.

Steps: (1) one Python pass makes, per document, a hash of the set, a signature of 256 bins and its band keys; (2) equal sets
become one class, found by partial aggregation, so a group of copies of any size costs one row; (3) classes that share a band
form a bucket, whose hub is the member with most bucket companions; hub-member edges are confirmed on full sets; (4) so that stars
lose no link, members that their hub didn't confirm are compared by size and signatures with the rest of the bucket, in blocks of
bounded size, and pairs that may reach the threshold (five standard deviations of slack) are confirmed on full sets; a bucket of n
members with u unconfirmed ones costs u x n such comparisons, and its rows are copied u / BLOCK times; (5) components of confirmed edges.

Cases: null ids are linked with nothing (component_id null, kept); rows that repeat an id give one result row each, in the
component of its own text; ties take the smallest id; an empty table gives an empty result; texts of any length are hashed whole, alone
if they exceed a shard; extra columns, whatever their names, are ignored (near_duplicates) or kept (near_dedup). A class is named by its smallest id; if several
classes have the same one, each is named by a hash of its set. near_dedup removes by id and text, and leaves one row of a component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ODD, SPACED, U64, carried, discard, flat, id_text, in_memory, list_column, mix, past_driver, relieve, shards, span_hash, uncarried, words, written
from .graph import components

BINS = 256
#: Bins of the signature that pairs are compared by before their full sets are: 2^WIDE_BITS, none filled from another.
WIDE_BITS = 10
#: Members of a bucket that one task compares with as many others.
BLOCK = 1024
#: Edges of one hub that one task confirms.
SALT = 1000
EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(col: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct shingle hashes of row r are hashes[bounds[r]:bounds[r + 1]]."""
    buf, off = flat(col)
    low, starts, ends, first = words(buf, off, SPACED)
    h = span_hash(low, starts, ends)
    n, rows = np.diff(first), len(first) - 1
    of = np.repeat(np.arange(rows), n)
    if len(h) >= k:
        s = sum(h[j : len(h) - k + 1 + j] * ODD[j] for j in range(k))
        whole = np.arange(len(s)) + k <= first[1:][of[: len(s)]]
        s, d = s[whole], of[: len(s)][whole]
    else:
        s, d = np.zeros(0, U64), np.zeros(0, np.int64)
    for short in range(1, k):
        r = np.flatnonzero(n == short)
        if len(r):
            s = np.concatenate([s, sum(h[first[r] + j] * ODD[j] for j in range(short)) + ODD[32 + short]])
            d = np.concatenate([d, r])
    s = mix(s)
    order = np.argsort(s)
    order = order[np.argsort(d[order].astype(np.uint16 if rows < 65536 else np.int64), kind="stable")]
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    s, d = s[new], d[new]
    return s, np.searchsorted(d, np.arange(rows + 1))


#: probe[a, j]: the bin that empty bin j tries in attempt a, the same for every document.
_PROBE = (mix(np.arange(4096 * BINS, dtype=U64) + U64(77)) % U64(BINS)).astype(np.int64).reshape(4096, BINS)


def signatures(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash function, 256 bins by its top bits, least value in each; an empty bin takes the value of the first filled bin of its probe sequence."""
    rows = len(bounds) - 1
    d = np.repeat(np.arange(rows), np.diff(bounds))
    b = (s >> U64(56)).astype(np.int64)
    head = np.ones(len(s), bool)
    head[1:] = (b[1:] != b[:-1]) | (d[1:] != d[:-1])
    sig = np.full((rows, BINS), EMPTY, U64)
    sig[d[head], b[head]] = s[head]
    filled = sig != EMPTY
    one = np.flatnonzero(filled.sum(1) == 1)
    sig[one] = sig[one].min(1, keepdims=True)
    r, j = np.nonzero((sig == EMPTY) & (filled.sum(1) > 1)[:, None])
    for a in range(len(_PROBE)):
        if not len(r):
            break
        to = _PROBE[a, j]
        hit = filled[r, to]
        sig[r[hit], j[hit]] = sig[r[hit], to[hit]]
        r, j = r[~hit], j[~hit]
    return sig


def band_shape(percent: int) -> tuple[int, int]:
    """(rows in a band, bands): as selective as 256 bins allow while a pair at the threshold is missed with probability below 1e-8."""
    p = percent / 100
    rows = max([r for r in range(1, 9) if (1 - p**r) ** (BINS // r) < 1e-8], default=1)
    return rows, BINS // rows


def sketches(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, text_h: of the text, n_shingles, h1, h2: of the set, bands, sig) for every row; all from one pass over the text."""
    rows, bands = band_shape(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shards(batches):
            s, bounds = shingle_sets(b.column("text"))
            n = np.diff(bounds)
            padded = np.append(s, U64(0))
            sums = [np.where(n > 0, np.add.reduceat(mix(padded + U64(c)), bounds[:-1]), U64(0)) for c in (11, 23)]
            sig = signatures(s, bounds)
            keys = np.stack([mix(sum(sig[:, x * rows + j] * ODD[j] for j in range(rows)) + U64(x + 1)) for x in range(bands)], 1)
            n_keys = np.where(n > 0, bands, 0)
            low = mix(sig.copy()).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_h"), pa.array(n, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), list_column(keys[n > 0].reshape(-1).view(np.int64), np.concatenate([[0], np.cumsum(n_keys)]), pa.int64()), pa.array([x.tobytes() for x in low], pa.binary())],
                names=["doc_id", "text_h", "n_shingles", "h1", "h2", "bands", "sig"],
            )

    return docs.withColumn("text_h", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_h long, n_shingles long, h1 long, h2 long, bands array<long>, sig binary")


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles: all hashes of the set, wide: its wide signature) of the rows in nodes (doc_id, text_h, node); the text of no other is used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shards(batches):
            s, bounds = shingle_sets(b.column("text"))
            d = np.repeat(np.arange(b.num_rows), np.diff(bounds))
            bin_ = (s >> U64(64 - WIDE_BITS)).astype(np.int64)
            head = np.ones(len(s), bool)
            head[1:] = (bin_[1:] != bin_[:-1]) | (d[1:] != d[:-1])
            wide = np.zeros((b.num_rows, 1 << WIDE_BITS), np.uint8)
            wide[d[head], bin_[head]] = np.maximum(s[head].astype(np.uint8), 1)
            yield pa.RecordBatch.from_arrays([b.column("node"), list_column(s.view(np.int64), bounds, pa.int64()), pa.array([x.tobytes() for x in wide], pa.binary())], names=["node", "shingles", "wide"])

    wanted = docs.withColumn("text_h", F.xxhash64("text")).join(F.broadcast(nodes) if in_memory(nodes.count()) else nodes, ["doc_id", "text_h"]).select("node", "text")
    return written(wanted.mapInArrow(run, "node long, shingles array<long>, wide binary"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) linked on full sets; a document with many pairs is salted."""
    sets = sets.select("node", "shingles")
    parts = pairs.groupBy("a").agg(F.expr(f"cast(ceil(count(*) / {SALT}) as int)").alias("parts"))
    salted = pairs.withColumn("part", F.expr("cast(pmod(xxhash64(b), 1000003) as int)"))
    left = sets.join(parts, sets.node == parts.a).select("a", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("shingles").alias("sa"))
    right = salted.join(sets, salted.b == sets.node).select("a", "b", "part", F.col("shingles").alias("sb")).join(parts, "a").withColumn("part", F.col("part") % F.col("parts")).drop("parts")
    both = right.join(left, ["a", "part"]).withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.expr(f"100 * both >= {percent} * (size(sa) + size(sb) - both)")).select("a", "b")


def _alike(percent: int):
    """Pairs of a block that may reach the threshold: by size, by the 256 bins, then by the wide signature, five standard deviations of slack each."""
    p = percent / 100
    least = int(BINS * p - 5.5 * math.sqrt(BINS * p * (1 - p)))

    def run(t: pa.Table) -> pa.Table:
        asks, node, near, n = (t.column(c).to_numpy() for c in ("asks", "node", "near", "n"))
        sig, wide = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(t.num_rows, -1) for c in ("sig", "wide"))
        x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
        out_a, out_b = [], []
        for k in x:
            maybe = y[(node[y] > node[k]) | (near[y] & (node[y] != node[k]))]  # two that ask meet once
            maybe = maybe[np.minimum(n[maybe], n[k]) >= p * np.maximum(n[maybe], n[k]) - 1e-9]
            maybe = maybe[(sig[maybe] == sig[k]).sum(1) >= least] if len(maybe) else maybe
            if not len(maybe):
                continue
            w = wide[maybe]
            either = ((w | wide[k]) != 0).sum(1)
            same = ((w == wide[k]) & (w != 0)).sum(1)
            part = np.minimum(1, either / np.maximum(1, (n[maybe] + n[k]) / (1 + p)))
            slack = 5 * np.sqrt(p * (1 - p) / np.maximum(either, 1) * (1 - part)) + 0.01
            hit = maybe[same >= (p - slack) * either]
            out_a.append(np.minimum(node[hit], node[k]))
            out_b.append(np.maximum(node[hit], node[k]))
        join = lambda v: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64())
        return pa.table({"a": join(out_a), "b": join(out_b)})

    return run


def links(docs: DataFrame, percent: int = 85) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, edges, classes): every row's doc_id, text_h, n_shingles, class (smallest doc_id with an equal set, null without
    words) and node (the key of its class); confirmed edges between nodes; the class of every node."""
    docs = id_text(docs)
    relieve(docs.sparkSession)
    made = written(sketches(docs, percent))
    of_set = ["h1", "h2", "n_shingles"]
    counted = written(made.where("doc_id is not null and n_shingles > 0").groupBy(*of_set).agg(F.min("doc_id").alias("class"), F.count("*").alias("copies")))
    shared = written(counted.groupBy("class").agg(F.count("*").alias("k")).where("k > 1").select("class", F.lit(True).alias("shared")))
    shared = F.broadcast(shared) if in_memory(shared.count()) else shared
    classes = written(counted.join(shared, "class", "left").withColumn("node", F.when(F.col("shared"), F.xxhash64(*of_set)).otherwise(F.col("class"))).drop("shared"))
    # sets that hold over 1/1000 of all rows, so fewer than 1000, are broadcast; the others are joined
    total = made.count()
    hot = made.select("doc_id", "text_h", *of_set).join(F.broadcast(classes.where(F.col("copies") * 1000 > total).drop("copies")), of_set, "left")
    cold = hot.where("class is null").drop("class", "node").join(classes.where(F.col("copies") * 1000 <= total).drop("copies"), of_set, "left")
    # null ids are in no class; rows without words have a key that is theirs, but no class
    members = hot.where("class is not null").unionByName(cold).select("doc_id", "text_h", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class"), F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node"))
    members = written(members)
    key = ["doc_id", *of_set]
    heads = made.join(classes.select(F.col("class").alias("doc_id"), *of_set, "node"), key).dropDuplicates(key)
    keys = heads.select("node", F.posexplode("bands").alias("band", "key"))
    crowd = keys.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    at = written(keys.join(crowd, ["band", "key"]))
    degree = written(at.groupBy("node").agg(F.sum("size").alias("degree")))
    hubs = at.join(degree, "node").groupBy("band", "key").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("hub"))
    placed = written(at.join(hubs, ["band", "key"]))
    alone = written(heads.select("doc_id", "text_h", "node", "sig", F.col("n_shingles").alias("n")).join(degree.select("node"), "node", "left_semi"))
    shingled = full_sets(docs.where("doc_id is not null"), alone.select("doc_id", "text_h", "node"))
    sets = shingled.dropDuplicates(["node"])
    first = written(placed.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    relieve(docs.sparkSession)
    star = written(confirmed(first, sets, percent))
    # what the hub didn't confirm asks all of its bucket, block by block; what it confirmed doesn't ask
    near = placed.join(star.select(F.col("a").alias("hub"), F.col("b").alias("node"), F.lit(True).alias("ok")), ["hub", "node"], "left")
    near = near.withColumn("near", F.coalesce("ok", F.col("node") == F.col("hub"))).drop("ok")
    mixed = near.groupBy("band", "key").agg(F.count("*").alias("n"), F.count(F.when(~F.col("near"), 1)).alias("left")).where("left > 0 and n > 2").select("band", "key", F.expr(f"cast(ceil(n / {BLOCK}) as int)").alias("all_blocks"), F.expr(f"cast(ceil(left / {BLOCK}) as int)").alias("asking_blocks"))
    open_ = written(near.select("band", "key", "node", "near").join(mixed, ["band", "key"]))
    rest = open_.join(alone.select("node", "sig", "n").join(sets.select("node", "wide"), "node"), "node")
    own = lambda blocks: F.expr(f"cast(pmod(xxhash64(node), {blocks}) as int)")
    every = lambda blocks: F.explode(F.expr(f"sequence(0, {blocks} - 1)"))
    sides = ["band", "key", "node", "near", "n", "sig", "wide"]
    asking = rest.where(~F.col("near")).select(*sides, F.lit(True).alias("asks"), own("asking_blocks").alias("i"), every("all_blocks").alias("j"))
    asked = rest.select(*sides, F.lit(False).alias("asks"), own("all_blocks").alias("j"), every("asking_blocks").alias("i"))
    found = asking.unionByName(asked).groupBy("band", "key", "i", "j").applyInArrow(_alike(percent), "a long, b long").distinct()
    relieve(docs.sparkSession)
    more = written(found.join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    edges = written(star.unionByName(confirmed(more, sets, percent)))
    discard(docs.sparkSession, at, alone, degree, placed, first, star, open_, more, shingled)
    relieve(docs.sparkSession)
    return members, edges, classes.select("node", "class")


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """members of links() with component (its key), component_id (its smallest doc_id) and kept."""
    with past_driver(docs.sparkSession):
        members, edges, classes = links(docs, percent)
        found = written(components(edges))
    least = found.join(classes, "node").groupBy("component").agg(F.min("class").alias("least"))
    placed = members.join(found.join(least, "component"), "node", "left")
    own = F.col("class").isNotNull()
    placed = placed.withColumn("component_id", F.coalesce(F.when(own, F.col("least")), "class", "doc_id")).withColumn("component", F.when(own, F.coalesce("component", "node")))
    return placed.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept (has the smallest id of its component, that of the one document that stays)."""
    return _grouped(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def near_dedup(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one row of each component, of its smallest id (of several, the least hash of text); all columns stay.

    Rows without an id or words are in no component and stay."""
    held = lambda df: F.broadcast(df) if in_memory(df.count()) else df
    grouped = _grouped(docs, percent).select("doc_id", "text_h", "component", "kept")
    with past_driver(docs.sparkSession):
        rows = written(grouped)
    first = rows.where("kept and component is not null")
    repeats = written(first.groupBy("component").agg(F.count("*").alias("n"), F.min("text_h").alias("least")).where("n > 1").drop("n"))
    again = first.join(held(repeats), "component")
    gone = rows.where(~F.col("kept")).select("doc_id", "text_h").unionByName(again.where("text_h <> least").select("doc_id", "text_h"))
    gone = written(gone.distinct().toDF("_gone", "_gone_h"))
    equal = written(again.where("text_h = least").groupBy("doc_id", "text_h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_gone"), F.col("text_h").alias("_gone_h")))
    whole = carried(docs, _id=F.col("doc_id").cast("long"), _h=F.xxhash64(F.col("text").cast("string")))
    same = (F.col("_id") == F.col("_gone")) & (F.col("_h") == F.col("_gone_h"))
    left = whole.join(held(gone), same, "left_anti")
    if equal.isEmpty():
        return uncarried(left, docs.columns)
    # rows of equal id and text become one, the first by all its columns
    one = whole.join(held(equal), same, "left_semi").groupBy("_id", "_h").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return uncarried(left.join(held(equal), same, "left_anti").select("_row").unionByName(one.select("_row")), docs.columns)

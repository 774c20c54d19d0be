"""Benchmark decontamination with training suffix arrays.

Each shard of documents gets a suffix array over its words (`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, A-Z lower-cased), sorted as
deep as the longest benchmark item. Suffixes of items are looked up by binary search, one more word at a time: equal beginnings are
searched once, and what isn't found takes no further step. A window is 10 consecutive words of an item; a shorter item is one
window. A document word inside any occurrence of a window is hit; a document with a hit is contaminated. Occurrences of a window are
an interval of the suffix array, so a place is listed once for each length of window (10 at most), however often the benchmark
repeats itself; longer matches are followed from a place along one path of beginnings.

Documents never leave their shard, so nothing is shuffled. The benchmark is broadcast in blocks of at most BLOCK_BYTES of text (or
one item, whose size the README's limits state): items beyond one block are searched in further passes, whose input is the table
that the last pass has written.

Cases: a null or wordless text has no words and no hits; items without words are no windows; items with null id hit, but stand in
no list of items; items that share an id count once; every row of documents gives one row, whatever it repeats; an empty benchmark
hits nothing, an empty table gives an empty result; texts of any length are searched whole, alone if they exceed a shard; extra
columns, whatever their names, are ignored (report) or kept (clean). Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, U64, carried, flat, id_text, shards, span_hash, uncarried, words, written

WINDOW = 10
#: Text bytes of the benchmark that are broadcast at once.
BLOCK_BYTES = 16 << 20
_END = U64(0)


def item_words(texts: list[str]) -> list[np.ndarray]:
    low, starts, ends, first = words(*flat(pa.array(texts, pa.string())), ALNUM)
    h = span_hash(low, starts, ends) | U64(1)
    return [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def suffix_array(h: np.ndarray, depth: int) -> np.ndarray:
    """Positions of h in the order of their next `depth` values: ranks of single words, then doubled where ranks still tie."""
    n = len(h)
    sa = np.argsort(h)
    s = h[sa]
    head = np.ones(n, bool)
    head[1:] = s[1:] != s[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    group = np.flatnonzero(head)[np.cumsum(head) - 1]
    rank[sa] = group
    step = 1
    while step < depth:
        tied = ~(head & np.append(head[1:], True))
        at = np.flatnonzero(tied)
        if not len(at):
            break
        pos = sa[at]
        key = rank[pos] * (n + 2) + rank[np.minimum(pos + step, n)] + 1
        order = np.argsort(key)
        pos, key = pos[order], key[order]
        sa[at] = pos
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        head[at] = new
        group = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        rank[pos] = group
        step *= 2
    return sa


class Suffixes:
    """Every suffix of the items of one block, sorted, to be looked up together."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int = WINDOW):
        self.names, self.window = [name for name, _ in items], window
        sizes = np.array([len(w) for _, w in items], np.int64)
        self.depth = int(sizes.max(initial=1))
        # a separator after each item, which no document holds
        words = np.concatenate([np.append(w, _END) for _, w in items]) if items else np.zeros(0, U64)
        end = np.repeat(np.cumsum(sizes + 1) - 1, sizes + 1)
        item = np.repeat(np.arange(len(items)), sizes + 1)
        need = np.minimum(window, sizes)[item]
        left = end - np.arange(len(words))
        order = suffix_array(words, self.depth) if len(words) else np.zeros(0, np.int64)
        order = order[left[order] >= need[order]]  # suffixes that begin a window
        self.words, self.at, self.item, self.left, self.need = np.append(words, np.full(self.depth + 1, _END)), order, item[order], left[order], need[order]
        self.before = np.where(order > 0, self.words[order - 1], _END)

    def search(self, h: np.ndarray, sa: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cover, hit rows, hit items: each pair once, places of longest matches, their (item, words)): what the shard h holds.

        cover: words hit, as +1 and -1 at the ends of windows. A place's longest match is left out where that of the place before goes on."""
        n = len(h)
        padded = np.append(h, np.zeros(self.depth + 1, U64))
        cover = np.zeros(n + 1, np.int64)
        length, who = np.zeros(n, np.int64), np.full(n, -1)
        follows = np.zeros(n, bool)  # every match here continues one of the place before
        rows_hit, items_hit = [], []
        live = np.arange(len(self.at))
        group = np.zeros(len(live), np.int64)  # equal beginnings have the same number
        lo, hi = np.zeros(1, np.int64), np.full(1, n, np.int64)
        for d in range(self.depth + 1):
            full = np.flatnonzero(self.need[live] == d)
            if len(full):  # windows that end here
                done, first = np.unique(group[full], return_index=True)
                places, of = _inside(sa, lo[done], hi[done])
                np.add.at(cover, places, 1)
                np.add.at(cover, places + d, -1)
                longer = length[places] < d
                length[places[longer]], who[places[longer]] = d, live[full[first]][of[longer]]
                which = np.searchsorted(done, group[full])
                self._hits(row, places, of, live[full], which, len(done), rows_hit, items_hit)
                self._follow(padded, places, of, live[full], which, len(done), follows)
                if d >= self.window:  # go on only where some match begins
                    go = np.zeros(len(lo), bool)
                    go[done[of[~follows[places]]]] = True
                    live, group = live[go[group]], group[go[group]]
            was, first = np.unique(group, return_index=True)
            reps = live[first]
            more = self.left[live] > d
            live, group = live[more], group[more]
            want = self.words[self.at[live] + d]
            head = np.ones(len(live), bool)
            head[1:] = (group[1:] != group[:-1]) | (want[1:] != want[:-1])
            first = np.flatnonzero(head)
            parent = group[first]
            x = _bound(padded, sa, lo[parent], hi[parent], want[first], d, False)
            y = _bound(padded, sa, x, hi[parent], want[first], d, True)
            found = y > x
            if d >= self.window:  # what no word continues: between the intervals of longer beginnings
                opens, closes = np.sort(np.concatenate([lo[was], y[found]])), np.sort(np.concatenate([x[found], hi[was]]))
                gaps = np.flatnonzero(closes > opens)
                places, of = _inside(sa, opens[gaps], closes[gaps])
                length[places], who[places] = d, reps[np.searchsorted(lo[was], opens[gaps], "right") - 1][of]
            child = (np.cumsum(head) - 1).astype(np.int64)
            keep = found[child] if len(live) else np.zeros(0, bool)
            live, group = live[keep], (np.cumsum(found) - 1)[child[keep]]
            lo, hi = x[found], y[found]
            if not len(live):
                break
        return cover, *(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rows_hit, items_hit)), *self._longest(length, who, follows)

    def _hits(self, row, places, of, suffixes, group, n, rows_hit, items_hit) -> None:
        """Adds (row, item) of windows that end here; groups with equal items are taken together."""
        order = np.lexsort((self.item[suffixes], group))
        items, group = self.item[suffixes][order], group[order]
        bounds = np.searchsorted(group, np.arange(n + 1))
        sets: dict[bytes, int] = {}
        members: list[np.ndarray] = []
        number = np.empty(n, np.int64)
        for g in range(n):
            own = np.unique(items[bounds[g] : bounds[g + 1]])
            number[g] = sets.setdefault(own.tobytes(), len(members))
            if number[g] == len(members):
                members.append(own)
        pairs = np.unique(row[places] * len(members) + number[of])
        for r, m in zip((pairs // len(members)).tolist(), (pairs % len(members)).tolist(), strict=True):
            rows_hit.append(np.full(len(members[m]), r))
            items_hit.append(members[m])

    def _follow(self, padded, places, of, suffixes, group, n, follows) -> None:
        """Marks places before which the text goes on as before all suffixes of their group (where those have one word before)."""
        low, high = np.full(n, ~U64(0)), np.zeros(n, U64)
        np.minimum.at(low, group, self.before[suffixes])
        np.maximum.at(high, group, self.before[suffixes])
        one = np.where((low == high) & (low != _END), low, _END)
        before = np.where(places > 0, padded[places - 1], _END)
        follows[places] |= (one[of] != _END) & (one[of] == before)

    def _longest(self, length: np.ndarray, who: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, items, words) of matches that no match of the place before holds."""
        hit = np.flatnonzero(length)
        # where all matches follow on, the length is what is left of the last place that has one of its own
        own = hit[~follows[hit]]
        last = np.append(own, -1)[np.searchsorted(own, hit, "right") - 1]
        real = np.where(follows[hit], np.maximum(length[last] - (hit - last), 0), length[hit])
        full = np.zeros(len(length) + 1, np.int64)
        full[hit] = real
        begins = own[(own == 0) | (full[own - 1] <= length[own])]
        return begins, self.item[who[begins]], length[begins]


def _inside(sa: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, which interval) of all intervals of the suffix array."""
    count = hi - lo
    of = np.repeat(np.arange(len(lo)), count)
    return sa[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(len(of))], of


def _bound(h: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, d: int, above: bool) -> np.ndarray:
    lo, hi = lo.copy(), hi.copy()
    last = len(sa) - 1
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        v = h[sa[np.minimum(mid, last)] + d]
        right = ((v <= want) if above else (v < want)) & open_
        lo = np.where(right, mid + 1, lo)
        hi = np.where(~right & open_, mid, hi)
    return lo


def _search_shard(col: pa.Array, query: Suffixes) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]], list[list[dict]]]:
    """(words, merged hit spans, items, longest matches) of each row."""
    low, starts, ends, first = words(*flat(col), ALNUM)
    rows, n = len(first) - 1, np.diff(first)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
    items: list[set[str]] = [set() for _ in range(rows)]
    matches: list[list[dict]] = [[] for _ in range(rows)]
    if not len(starts) or not len(query.at):
        return n, spans, items, matches
    # a separator after each document keeps matches inside it
    of = np.repeat(np.arange(rows), n)
    h = np.full(len(starts) + rows, _END, U64)
    h[np.arange(len(starts)) + of] = span_hash(low, starts, ends) | U64(1)
    row = np.repeat(np.arange(rows), n + 1)
    begin = first[:-1] + np.arange(rows)
    cover, rows_hit, items_hit, places, which, length = query.search(h, suffix_array(h, query.depth), row)
    for r, i in zip(rows_hit.tolist(), items_hit.tolist(), strict=True):
        if query.names[i] is not None:
            items[r].add(query.names[i])
    inside = (np.cumsum(cover)[:-1] > 0).astype(np.int8)
    edge = np.diff(np.concatenate([[0], inside, [0]]))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        r = row[a]
        spans[r].append((a - int(begin[r]), b - int(begin[r])))
    for p, q, k in zip(places.tolist(), which.tolist(), length.tolist(), strict=True):
        matches[row[p]].append({"item": query.names[q], "start": p - int(begin[row[p]]), "words": k})
    return n, spans, items, matches


def _merged(a: list, b: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted([tuple(s) for s in a] + list(b)):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


_FOUND = pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int64()))), ("matches", pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("words", pa.int64())])))])

_MATCH = T.StructType([T.StructField("item", T.StringType()), T.StructField("start", T.LongType()), T.StructField("words", T.LongType())])
_FOUND_SQL = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("matches", T.ArrayType(_MATCH))])


def _blocks(benchmark: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of a hash of the item that hold at most about `most` bytes each; one range if the benchmark is small."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return [(k, max(1, -(-total // most))) for k in range(max(1, -(-total // most)))]


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """doc_id and _found: n_words, items (sorted ids of items with occurring windows), spans (hit words, merged [start, end)),
    matches (item, null where it has no id, start, words of each verbatim match of a window or more, as long as it goes). carry: `_row` with all columns of docs instead of doc_id."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).dropna(subset=["text"]).distinct()
    src = carried(docs, _text=F.col("text").cast("string")) if carry else id_text(docs).withColumn("_text", F.col("text")).drop("text")
    # passes carry the text along only while further blocks are to come
    blocks = _blocks(bench, block_bytes)
    kept = [c for c in src.columns if c != "_text"]
    for k, n in blocks:
        mine = bench if n == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = mine.collect()  # bounded by block_bytes
        items = [(r.item_id, w) for r, w in zip(rows, item_words([r.text for r in rows]), strict=True) if len(w)] if rows else []
        query = spark.sparkContext.broadcast(Suffixes(items, window))
        again, more = "_found" in src.columns, k + 1 < n
        out = src.select(*kept, *(["_text"] if more else [])).schema

        def run(batches: Iterator[pa.RecordBatch], query=query, again=again, more=more) -> Iterator[pa.RecordBatch]:
            for b in shards(batches, "_text"):
                n_words, spans, items, matches = _search_shard(b.column("_text"), query.value)
                found = [{"n_words": int(n_words[r]), "items": sorted(items[r]), "spans": spans[r], "matches": matches[r]} for r in range(b.num_rows)]
                if again:
                    for x, y in zip(found, b.column("_found").to_pylist(), strict=True):
                        x |= {"items": sorted({*x["items"], *y["items"]}), "spans": _merged(y["spans"], x["spans"]), "matches": y["matches"] + x["matches"]}
                names = [*kept, *(["_text"] if more else [])]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(found, _FOUND)], names=[*names, "_found"])

        src = src.mapInArrow(run, out.add("_found", _FOUND_SQL))
        if more:
            src = written(src)
    return src


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items, longest (words of the longest match, 0 if none), spans, matches, contaminated."""
    f = F.col("_found")
    hit = F.aggregate(f["spans"], F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    found = contaminated(docs, benchmark, window, block_bytes)
    return found.select("doc_id", f["n_words"].alias("n_words"), hit.alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"), f["items"].alias("items"), F.coalesce(F.array_max(f["matches"]["words"]), F.lit(0).cast("long")).alias("longest"), f["spans"].alias("spans"), f["matches"].alias("matches"), (F.size(f["spans"]) > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without contaminated documents; all columns stay."""
    return uncarried(contaminated(docs, benchmark, window, block_bytes, carry=True).where(F.size("_found.spans") == 0), docs.columns)



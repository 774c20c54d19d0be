"""Toxicity: a convolutional text classifier over hashed words, trained in numpy.

A word (`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, A-Z lower-cased) is the sum of hashed embeddings of itself and of its first 4 and
6 bytes. Filters of widths 1, 2 and 3 run over the words of the whole text, each filter's largest value goes into a logistic
layer. Learning takes every labelled row and its whole text. Rows are dealt by hash into chunks of about CHUNK bytes of text; tasks
move the networks over a chunk each, from the same state, and the states are averaged and start the next turn. What the driver
holds is the networks and counts, whatever the number of rows.

Thresholds are calibrated by language, which is predicted from the text and never read from the table: the first 6 bytes of each
word vote by how often they stand in texts of each language (naive Bayes; counts over all given rows with a language). Per predicted
language with at least 15 rows of either label, the threshold of best F1 over all labelled rows, their logits rounded to 1 / CELLS, is
moved to CUT by a shift of the logit, so a score of at least CUT means toxic in every language. Cases: an empty or null text has no
words and gets the score of a text without any evidence, which is below CUT; without labels of both kinds every score is 0; other
labels, null among them, and null ids are not learned from; rows that repeat get equal scores; an empty table gives
an empty result; texts of any length are scored whole, alone if they exceed a shard; extra columns, whatever their names, are ignored
(`scored`) or kept (`without_toxic`).
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, U64, bounded, carried, discard, flat, id_text, in_memory, mix, relieve, shards, span_hash, uncarried, words, written

CUT = 0.3
#: Least distance, in the logit, of any threshold from a text without evidence.
MARGIN = 0.1
#: Bytes of text that a network learns from between two averages, about; one longer text is not parted.
CHUNK = 16 << 20
#: Bytes of text in a row of the table of chunks, at most; one longer text is a row.
PIECE = 1 << 19
#: Parts of 1 into which logits are rounded for thresholds.
CELLS = 1024
#: Buckets whose averages are summed in one group.
BLOCK = 1 << 12
#: See train().
REST, SURE = 2, 0.05
#: Networks whose mean is the model.
MEMBERS = 3
BUCKETS = 1 << 15
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 6
_PREFIXES = (4, 6)


def hashed(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first): three buckets of each word; the words of row r are first[r]:first[r + 1]."""
    low, starts, ends, first = words(*flat(col), ALNUM)
    out = np.empty((len(starts), 1 + len(_PREFIXES)), np.int32)
    for k, size in enumerate((None, *_PREFIXES)):
        to = ends if size is None else np.minimum(ends, starts + size)
        h = span_hash(low, starts, to) ^ U64(0x51ED270B * k)
        out[:, k] = (h % U64(BUCKETS)).astype(np.int32)
    return out, first


@dataclasses.dataclass
class Languages:
    """Log shares of each language's words (table[language, bucket]), by the last kind of bucket."""

    names: list[str]
    table: np.ndarray

    def spoken(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The likeliest language of each row, the first of equal ones; `und` without words."""
        out = np.full(len(first) - 1, "und", object)
        full = np.flatnonzero(first[1:] > first[:-1])
        if len(full) and self.names:
            at, starts = buckets[:, -1], first[:-1][full]
            best = np.argmax([np.add.reduceat(t[at], starts) for t in self.table], 0)
            out[full] = np.array(self.names, object)[best]
        return out


@dataclasses.dataclass
class Model:
    """embed: per kind of feature and bucket; filters[w]: (w, DIM, FILTERS); shift: of the logit, by language."""

    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    shift: dict[str, float]
    languages: Languages | None
    blank: bool = False

    def tables(self) -> np.ndarray:
        """What each bucket adds to each filter's position: embeddings times filters, once for all."""
        flat_filters = np.concatenate([f.transpose(1, 0, 2).reshape(f.shape[1], -1) for f in self.filters], axis=1)
        return (self.embed @ flat_filters).astype(np.float32)

    def pooled(self, buckets: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Largest value of each filter over each row's words; windows over a text's end see zeros."""
        rows, n, filters = len(first) - 1, np.diff(first), len(self.bias[0])
        values = table[0][buckets[:, 0]]
        for k in range(1, buckets.shape[1]):
            values += table[k][buckets[:, k]]
        out, at = np.zeros((rows, filters * len(WIDTHS)), np.float32), 0
        full = np.flatnonzero(n > 0)
        of = np.repeat(np.arange(rows), n)
        for w, width in enumerate(WIDTHS):
            v = values[:, at * filters : (at + 1) * filters].copy()
            for j in range(1, width):
                part = values[j:, (at + j) * filters : (at + j + 1) * filters]
                same = of[j:] == of[: len(of) - j]
                v[: len(part)] += np.where(same[:, None], part, 0)
            if len(full):
                out[full, w * filters : (w + 1) * filters] = np.maximum(np.maximum.reduceat(v, first[:-1][full], axis=0) + self.bias[w], 0)
            at += width
        return out

    def logits(self, col: pa.Array, table: np.ndarray) -> np.ndarray:
        buckets, first = hashed(col)
        return self.pooled(buckets, first, table) @ self.out + self.out_bias

    def score(self, col: pa.Array, table: np.ndarray) -> np.ndarray:
        if self.blank:
            return np.zeros(len(col))
        buckets, first = hashed(col)
        z = self.pooled(buckets, first, table) @ self.out + self.out_bias
        common = self.shift.get("", 0.0)
        z = z + (np.array([self.shift.get(lang, common) for lang in self.languages.spoken(buckets, first)]) if self.languages else common)
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def _hashed_apart(texts: list[bytes], most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """hashed() of many texts, a part after the other."""
    parts, firsts, total = [], [np.zeros(1, np.int64)], 0
    for b in shards(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])]), most=most):
        buckets, first = hashed(b.column("text"))
        parts.append(buckets)
        firsts.append(first[1:] + total)
        total += len(buckets)
    return np.concatenate(parts), np.concatenate(firsts)


def _spans(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, bounds): the words of these rows, row after row."""
    n = first[rows + 1] - first[rows]
    bounds = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(first[rows] - bounds[:-1], n) + np.arange(bounds[-1]), bounds


def gradients(model: Model, ids: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray, float, list[tuple[np.ndarray, np.ndarray]]]:
    """Of a mini-batch whose row r has the words ids[bounds[r]:bounds[r + 1]] (at least one): (scores, and the gradients of the mean
    log loss by filters, bias, out, out_bias, and by kind of feature (buckets, rows of embed))."""
    total, rows = bounds[-1], len(bounds) - 1
    of = np.repeat(np.arange(rows), np.diff(bounds))
    e = sum(model.embed[k][ids[:, k]] for k in range(ids.shape[1]))
    pooled, where = [], []
    for w, width in enumerate(WIDTHS):
        v = e @ model.filters[w][0]
        for j in range(1, width):
            part = e[j:] @ model.filters[w][j]
            part[of[j:] != of[: total - j]] = 0
            v[: len(part)] += part
        best = np.maximum.reduceat(v, bounds[:-1], axis=0)
        at, f = np.nonzero(v == best[of])
        _, seen = np.unique(of[at] * FILTERS + f, return_index=True)  # the first place of each row's and filter's best
        pooled.append(best + model.bias[w])
        where.append(at[seen].reshape(rows, FILTERS))
    raw = np.concatenate(pooled, 1)
    act = np.maximum(raw, 0)
    score = 1 / (1 + np.exp(-(act @ model.out + model.out_bias)))
    d = ((score - y) / rows).astype(np.float32)
    back = d[:, None] * model.out[None] * (raw > 0)
    by_filter, by_bias, by_word = [np.zeros_like(f) for f in model.filters], [], []
    for w, width in enumerate(WIDTHS):
        g = back[:, w * FILTERS : (w + 1) * FILTERS]
        by_bias.append(g.sum(0))
        r, f = np.nonzero(g)
        value, at = g[r, f], where[w][r, f]
        for j in range(width):
            inside = at + j < bounds[1:][r]
            p, fj, vj = at[inside] + j, f[inside], value[inside]
            np.add.at(by_filter[w][j].T, fj, vj[:, None] * e[p])
            by_word.append((p, vj[:, None] * model.filters[w][j][:, fj].T))
    place, grad = (np.concatenate(x) for x in zip(*by_word, strict=True))
    by_embed = []
    for k in range(ids.shape[1]):
        seen, inverse = np.unique(ids[place, k], return_inverse=True)
        summed = np.zeros((len(seen), DIM), np.float32)
        np.add.at(summed, inverse, grad)
        by_embed.append((seen, summed))
    return score, by_filter, by_bias, act.T @ d, float(d.sum()), by_embed


def merged(models: list[Model]) -> Model:
    """One model whose logit is the mean of theirs: their embeddings and filters side by side."""
    n = len(models)
    filters = []
    for w, width in enumerate(WIDTHS):
        f = np.zeros((width, n * DIM, n * FILTERS), np.float32)
        for i, m in enumerate(models):
            f[:, i * DIM : (i + 1) * DIM, i * FILTERS : (i + 1) * FILTERS] = m.filters[w]
        filters.append(f)
    out = np.concatenate([m.out.reshape(len(WIDTHS), FILTERS) for m in models], 1).reshape(-1) / n
    return Model(np.concatenate([m.embed for m in models], 2), filters, [np.concatenate([m.bias[w] for m in models]) for w in range(len(WIDTHS))], out, float(np.mean([m.out_bias for m in models])), {}, None)


def train(texts: list[bytes], labels: list[int], rounds: int = 8, seed: int = 1, languages: Languages | None = None, members: int = MEMBERS) -> Model:
    """The mean of `members` networks, each of which leaves out another part of the rows; thresholds come from the scores of each row
    by the network that hasn't seen it. Texts in memory, as one chunk; see fit()."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return _blank(seed)
    buckets, first = _hashed_apart(texts)
    part = np.random.default_rng(seed).permutation(len(y)) % members
    full = first[1:] > first[:-1]  # rows without words tell nothing
    models, z = [], np.zeros(len(y))
    for i in range(members):
        rng = np.random.default_rng([seed, i])
        learner = Learner(_started(rng))
        for turns in _spells(rounds):
            learner.turn(buckets, first, y, np.flatnonzero((part != i) & full if members > 1 else full), turns, rng)
        m = learner.model
        own = np.flatnonzero(part == i)
        table = m.tables()
        for at in np.array_split(own, max(1, len(own) // 200)):
            places, bounds = _spans(first, at)
            z[at] = m.pooled(buckets[places], bounds, table) @ m.out + m.out_bias
        models.append(m)
    model = merged(models)
    model.languages = languages if languages and languages.names else None
    spoken = model.languages.spoken(buckets, first) if model.languages else np.full(len(texts), "", object)
    _calibrate(model, z, y, np.ones(len(y)), spoken)
    return model


def _blank(seed: int) -> Model:
    return dataclasses.replace(merged([_started(np.random.default_rng(seed))]), blank=True)


def _started(rng: np.random.Generator) -> Model:
    filters = [rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    return Model(rng.normal(0, 0.1, (1 + len(_PREFIXES), BUCKETS, DIM)).astype(np.float32), filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0.3, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), -1.0, {}, None)


def _spells(rounds: int) -> list[range]:
    """The turns in spells, each of which begins with a turn over all rows: turns from REST on, but for every 2 REST-th, are over rows
    whose last score wasn't within SURE of their label."""
    whole = [t for t in range(rounds) if t < REST or t % (2 * REST) == 0]
    return [range(a, b) for a, b in zip(whole, [*whole[1:], rounds], strict=True)]


class Learner:
    """A network and the state of its optimisers: Adam for the few dense arrays, AdaGrad for embeddings."""

    def __init__(self, model: Model):
        self.model = model
        self.model.out_bias = np.array([model.out_bias], np.float32)
        self.first = [np.zeros_like(v) for v in self.values()]
        self.second = [np.zeros_like(v) for v in self.values()]
        self.past = np.zeros_like(model.embed)
        self.step = 0.0

    def values(self) -> list[np.ndarray]:
        m = self.model
        return [*m.filters, *m.bias, m.out, m.out_bias]

    def dense(self) -> np.ndarray:
        """All but what belongs to buckets, as one row of numbers."""
        return np.concatenate([np.array([self.step])] + [v.reshape(-1).astype(np.float64) for v in (*self.values(), *self.first, *self.second)])

    def moved(self, dense: np.ndarray, embed: np.ndarray, past: np.ndarray) -> Learner:
        """A learner with these numbers in place of its own."""
        parts, at = [], 1
        for v in (*self.values(), *self.first, *self.second):
            parts.append(dense[at : at + v.size].reshape(v.shape).astype(np.float32))
            at += v.size
        n, w = len(self.first), len(WIDTHS)
        out = Learner(dataclasses.replace(self.model, embed=embed, filters=parts[:w], bias=parts[w : 2 * w], out=parts[2 * w], out_bias=0.0))
        out.model.out_bias, out.first, out.second, out.past, out.step = parts[n - 1], parts[n : 2 * n], parts[2 * n :], past, float(dense[0])
        return out

    def copy(self) -> Learner:
        return self.moved(self.dense(), self.model.embed.copy(), self.past.copy())

    def turn(self, buckets: np.ndarray, first: np.ndarray, y: np.ndarray, learn: np.ndarray, turns: range, rng: np.random.Generator) -> None:
        """Mini-batches of the log loss of the rows `learn`, for the turns of a spell."""
        model = self.model
        off = np.ones(len(y), np.float32)  # how far each row's last score was from its label
        for turn in turns:
            now = learn if turn == turns[0] else learn[off[learn] > SURE]
            for at in np.array_split(rng.permutation(now), max(1, len(now) // 32)):
                if not len(at):
                    continue
                self.step += 1
                places, bounds = _spans(first, at)
                score, by_filter, by_bias, by_out, by_out_bias, by_embed = gradients(model, buckets[places], bounds, y[at])
                off[at] = np.abs(score - y[at])
                # a quarter of each batch are texts without words besides, which aren't toxic
                grads = [*by_filter, *by_bias, by_out, by_out_bias + 0.25 / (1 + np.exp(-model.out_bias))]
                for value, grad, m, s in zip(self.values(), grads, self.first, self.second, strict=True):
                    m += 0.1 * (grad - m)
                    s += 0.001 * (grad * grad - s)
                    value -= 0.01 * (m / (1 - 0.9**self.step)) / (np.sqrt(s / (1 - 0.999**self.step)) + 1e-8)
                for k, (seen, total) in enumerate(by_embed):  # only the buckets that were touched; squared gradients of each add up
                    self.past[k][seen] += total * total
                    model.embed[k][seen] -= 0.05 * total / (np.sqrt(self.past[k][seen]) + 1e-8)


def _calibrate(model: Model, z: np.ndarray, y: np.ndarray, n: np.ndarray, spoken: np.ndarray, least: int = 15) -> None:
    """model.shift: by predicted language, and for all others together, what moves the best threshold of the logit to CUT.

    Of n[i] rows with the logit z[i] in the language spoken[i], y[i] are toxic."""
    at_cut, bias = float(np.log(CUT / (1 - CUT))), float(np.mean(model.out_bias))
    for lang in ["", *sorted(set(spoken))]:
        own = (spoken == lang) | (lang == "")
        if lang and min(y[own].sum(), (n - y)[own].sum()) < least or not 0 < y[own].sum() < n[own].sum():
            continue
        # a text that sets off no filter has the logit out_bias, and is never toxic
        model.shift[lang] = at_cut - max(_threshold(z[own], y[own], n[own]), bias + MARGIN)


def _threshold(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """In the widest gap among cuts of best F1, a third of it above the clean side: toxic texts with words never seen score lower."""
    order = np.argsort(-z)
    zs, hits, above = z[order], np.cumsum(y[order]), np.cumsum(n[order])
    f1 = 2 * hits / (above + y.sum())
    after = np.append(zs[1:], zs[-1] - 2)
    f1 = np.where(zs > after, f1, -1)
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    k = best[np.argmax(zs[best] - after[best])]
    return float(after[k] + (zs[k] - after[k]) / 3)


_PIECES = "chunk long, ids binary, words binary, label binary, part binary"


def _packed(docs: DataFrame, labels: DataFrame, each: int) -> DataFrame:
    """The labelled rows as written pieces of chunks: buckets, numbers of words, labels and parts of some rows each, chunk after chunk."""
    marks = labels.where("label in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).distinct()
    marks = F.broadcast(marks) if in_memory(marks.count()) else marks  # beyond that texts are shuffled by id, too
    rows = id_text(docs).join(marks, "doc_id")
    size = id_text(docs).select("doc_id", F.octet_length("text").alias("size")).join(marks, "doc_id").agg(F.sum("size")).first()[0] or 0
    chunk = F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(max(1, -(-size // each))))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("text", "ascending"), ("label", "ascending")])
        order = np.argsort(mix(t.column("doc_id").to_numpy().view(U64)), kind="stable")
        out = []
        for b in shards(iter(t.take(pa.array(order)).combine_chunks().to_batches()), most=PIECE):
            buckets, first = hashed(b.column("text"))
            part = mix(b.column("doc_id").to_numpy().view(U64) + U64(0x9E3779B97F4A7C15)) % U64(MEMBERS)
            held = (buckets.astype(np.uint16), np.diff(first).astype(np.int32), b.column("label").to_numpy().astype(np.uint8), part.astype(np.uint8))
            out.append([key[0].as_py(), *[x.tobytes() for x in held]])
        kinds = [pa.int64(), *[pa.binary()] * 4]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["chunk", "ids", "words", "label", "part"])

    return written(rows.select(chunk.alias("chunk"), "doc_id", "text", "label").groupBy("chunk").applyInArrow(pack, _PIECES))


def _unpacked(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, first, labels, parts) of pieces."""
    ids, n, y, part = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*rows, strict=True), (np.uint16, np.int32, np.uint8, np.uint8), strict=True))
    return ids.reshape(-1, 1 + len(_PREFIXES)), np.concatenate([[0], np.cumsum(n, dtype=np.int64)]), y.astype(np.float32), part


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(chunk, *_unpacked()) of pieces that follow each other."""
    now, rows = None, []
    for b in batches:
        for chunk, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if rows and chunk != now:
                yield now, *_unpacked(rows)
                rows = []
            now = chunk
            rows.append(row)
    if rows:
        yield now, *_unpacked(rows)


_MOVES = "member int, kind int, block int, chunk long, at binary, weight binary, moved binary"


def _summed(t: pa.Table) -> pa.Table:
    """The moves of one block by several tasks, as one."""
    rows = t.sort_by("chunk").to_pylist()
    dense = rows[0]["kind"] < 0
    size = len(rows[0]["moved"]) // 8 if dense else 2 * DIM
    weight, moved = np.zeros(1 if dense else BLOCK), np.zeros((1 if dense else BLOCK, size))
    for r in rows:
        at = np.frombuffer(r["at"], np.int32)
        weight[at] += np.frombuffer(r["weight"], np.float64)
        moved[at] += np.frombuffer(r["moved"], np.float64 if dense else np.float32).reshape(-1, size)
    return pa.Table.from_pylist([rows[0] | _move(weight, moved, np.float64 if dense else np.float32)], t.schema)


def _move(weight: np.ndarray, moved: np.ndarray, kind: type) -> dict:
    at = np.flatnonzero(weight)
    return {"at": at.astype(np.int32).tobytes(), "weight": weight[at].astype(np.float64).tobytes(), "moved": moved[at].astype(kind).tobytes()}


def _turned(chunks: DataFrame, learners: list[Learner], turns: range, seed: int) -> list[Learner]:
    """The learners after a spell: each goes over every chunk from where it stands, without its own part of the rows; numbers become the
    mean of what they became, weighted by rows, over all chunks or, of a bucket, over those that have moved it."""
    shared = chunks.sparkSession.sparkContext.broadcast(learners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases, sums, least = shared.value, {}, None
        for chunk, buckets, first, y, part in _chunks(batches):
            least = chunk if least is None else min(least, chunk)
            for i, base in enumerate(bases):
                learn = np.flatnonzero((part != i) & (first[1:] > first[:-1]))
                if not len(learn):
                    continue
                now = base.copy()
                now.turn(buckets, first, y, learn, turns, np.random.default_rng([seed, i, chunk, turns[0]]))
                if i not in sums:
                    shape = base.past.shape
                    sums[i] = [np.zeros(1), np.zeros((1, len(base.dense()))), np.zeros(shape[:2]), np.zeros((*shape[:2], 2 * DIM), np.float32)]
                weight, dense, touched, moved = sums[i]
                weight += len(learn)
                dense += (now.dense() - base.dense()) * len(learn)
                k, at = np.nonzero((now.past != base.past).any(2))
                touched[k, at] += len(learn)
                moved[k, at] += np.concatenate([now.model.embed[k, at] - base.model.embed[k, at], now.past[k, at] - base.past[k, at]], 1) * len(learn)
        for i, (weight, dense, touched, moved) in sums.items():
            rows = [{"kind": -1, "block": 0} | _move(weight, dense, np.float64)]
            rows += [{"kind": k, "block": b} | _move(touched[k, b * BLOCK : (b + 1) * BLOCK], moved[k, b * BLOCK : (b + 1) * BLOCK], np.float32) for k in range(len(touched)) for b in range(BUCKETS // BLOCK)]
            for r in rows:
                yield pa.RecordBatch.from_pylist([r | {"member": i, "chunk": least}], schema)

    schema = pa.schema([("member", pa.int32()), ("kind", pa.int32()), ("block", pa.int32()), ("chunk", pa.int64()), ("at", pa.binary()), ("weight", pa.binary()), ("moved", pa.binary())])
    moves = written(chunks.mapInArrow(run, _MOVES).groupBy("member", "kind", "block").applyInArrow(_summed, _MOVES))
    shared.destroy()
    out = []
    for i, base in enumerate(learners):
        dense, embed, past = base.dense(), base.model.embed.copy(), base.past.copy()
        for r in moves.where(F.col("member") == i).collect():  # the driver gets the moves of one network at a time
            if not r.at:
                continue
            weight = np.frombuffer(r.weight, np.float64)[:, None]
            if r.kind < 0:
                dense += np.frombuffer(r.moved, np.float64) / weight[0]
                continue
            at = np.frombuffer(r.at, np.int32) + r.block * BLOCK
            mean = (np.frombuffer(r.moved, np.float32).reshape(-1, 2 * DIM) / weight).astype(np.float32)
            embed[r.kind, at] += mean[:, :DIM]
            past[r.kind, at] += mean[:, DIM:]
        out.append(base.moved(dense, embed, past))
    discard(chunks.sparkSession, moves)
    relieve(chunks.sparkSession)
    return out


def learned_languages(docs: DataFrame) -> Languages:
    """Of all rows of docs with a language: doc_id, text, lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in shards(batches, most=PIECE):
            buckets, first = hashed(b.column("text"))
            langs, which = np.unique(b.column("lang").to_numpy(zero_copy_only=False), return_inverse=True)
            of = np.repeat(which, np.diff(first))
            for k, lang in enumerate(langs.tolist()):
                counts[lang] = counts.get(lang, 0) + np.bincount(buckets[of == k, -1], minlength=BUCKETS)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = bounded(docs).where("lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    got = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs, at, n = (got.column(c).to_numpy() for c in ("lang", "bucket", "n"))
    names = sorted(set(langs))
    table = np.full((len(names), BUCKETS), 0.5)
    for k, name in enumerate(names):
        table[k, at[langs == name]] += n[langs == name]
    return Languages(names, np.log(table / table.sum(1, keepdims=True)).astype(np.float32))


def _cells(chunks: DataFrame, learners: list[Learner], languages: Languages | None) -> tuple[np.ndarray, ...]:
    """(logits rounded to 1 / CELLS, toxic rows, rows, languages) of all rows, each by the network that hasn't seen it; equal ones together."""
    shared = chunks.sparkSession.sparkContext.broadcast(([learner.model for learner in learners], languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, languages = shared.value
        tables = [m.tables() for m in models]
        for b in batches:
            for _, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                buckets, first, y, part = _unpacked([row])
                z = np.zeros(len(y))
                for i, m in enumerate(models):
                    places, bounds = _spans(first, np.flatnonzero(part == i))
                    z[part == i] = m.pooled(buckets[places], bounds, tables[i]) @ m.out + m.out_bias
                spoken = languages.spoken(buckets, first) if languages else [""] * len(y)
                yield pa.RecordBatch.from_arrays([pa.array(np.rint(z * CELLS).astype(np.int64)), pa.array(y.astype(np.int64)), pa.array(spoken, pa.string())], names=["z", "y", "lang"])

    got = chunks.mapInArrow(run, "z long, y long, lang string").groupBy("lang", "z").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("lang", "z").toArrow()
    shared.destroy()
    return got.column("z").to_numpy() / CELLS, got.column("y").to_numpy(), got.column("n").to_numpy(), got.column("lang").to_numpy()


def fit(docs: DataFrame, labels: DataFrame, languages: Languages | None = None, rounds: int = 8, seed: int = 1, each: int = CHUNK) -> Model:
    """train() over all rows of docs that have a label. docs: doc_id, text. labels: doc_id, label (0 or 1)."""
    chunks = _packed(docs, labels, each)
    try:
        kinds = chunks.agg(F.max(F.instr(F.hex("label"), "00") > 0), F.max(F.instr(F.hex("label"), "01") > 0)).first()
        if not (kinds[0] and kinds[1]):
            return _blank(seed)
        learners = [Learner(_started(np.random.default_rng([seed, i]))) for i in range(MEMBERS)]
        for turns in _spells(rounds):
            learners = _turned(chunks, learners, turns, seed)
        model = merged([learner.model for learner in learners])
        model.languages = languages if languages and languages.names else None
        _calibrate(model, *_cells(chunks, learners, model.languages))
        return model
    finally:
        discard(chunks.sparkSession, chunks)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = model.tables()
        for b in shards(batches, most=1 << 20):
            score = model.score(b.column("text"), table)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64()), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return id_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without those scored toxic; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = model.tables()
        for b in shards(batches, "_text", most=1 << 20):
            keep = b.filter(pa.array(model.score(b.column("_text"), table) < CUT))
            yield pa.RecordBatch.from_arrays([keep.column("_row")], names=["_row"])

    src = carried(docs, _text=F.col("text").cast("string"))
    return uncarried(src.mapInArrow(run, src.select("_row").schema), docs.columns)

"""Language identification by error-correcting output codes.

Each language gets a codeword: a column of a code matrix of BITS rows whose codewords differ in many bits. One binary classifier
per bit, linear over hashed character n-grams (1 to 3 lower-cased code points, letters only, runs of others as one space),
predicts the bit of a text's language; decoding takes the codeword with the least loss, each bit weighted by how well its
classifier did in training. A text whose two nearest codewords are close is flagged ambiguous.

Learning takes a bounded sample of texts with a language (MOST rows of each, by a hash of the id, of at most LONGEST code points,
so what the driver collects is bounded in bytes); everything is predicted on whole texts. Cases: a null text, or one without letters
(Unicode's, of all planes; emoji and digits aren't), is `und` with score 0; with no labelled rows every text is `und`; with one
language that is every other text's; labels that tie take the smallest; rows that repeat get equal rows each; an empty table gives
an empty result; a text of any length is handled whole, alone if it exceeds a shard; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import flat, id_text, shards

#: Labelled rows of each language that the classifiers learn from.
MOST = 400
#: Code points of the longest text that they learn from.
LONGEST = 20_000
#: Bits of a codeword, at least; many languages get more.
BITS = 15
FEATURES = 1 << 13
#: Least score that isn't ambiguous.
CLEAR = 0.6


def code_matrix(n: int, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """n codewords of +1 and -1, the farthest apart of some random sets, with both values in every bit."""
    rng = np.random.default_rng(seed)
    if n == 1:
        return np.ones((1, bits))
    best, least = None, -1
    for _ in range(max(20, 2000 // n)):
        code = rng.choice([-1.0, 1.0], (n, bits))
        same = np.flatnonzero(np.abs(code.sum(0)) == n)  # such a bit would tell nothing
        code[rng.integers(0, n, len(same)), same] *= -1
        apart = int(((bits - code @ code.T) / 2 + np.eye(n) * bits).min())
        if apart > least:
            best, least = code, apart
    return best


def code_bits(n: int) -> int:
    """Bits with which random codewords of n languages stay far enough apart that several wrong bits are corrected."""
    return max(BITS, 6 * math.ceil(math.log2(max(n, 2))))


def _letter(c: int) -> int:
    """The lower-cased letter of a code point, 0 for whatever isn't a letter."""
    s = chr(c)
    if not s.isalpha():
        return 0
    low = s.lower()
    return ord(low) if len(low) == 1 else c


_LETTERS: list[np.ndarray] = []


def _codes(text: bytes) -> np.ndarray:
    """Lower-cased letters of a UTF-8 text, runs of other characters as one space."""
    if not _LETTERS:
        _LETTERS.append(np.array([_letter(x) for x in range(1 << 16)], np.uint32))
    c = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    beyond = c >= 1 << 16
    c = _LETTERS[0][np.where(beyond, 0, c)]
    if beyond.any():
        seen, which = np.unique(np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)[beyond], return_inverse=True)
        c[beyond] = np.array([_letter(int(x)) for x in seen], np.uint32)[which]
    c = np.where(c == 0, 32, c)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    return c[keep].astype(np.uint32)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, letters): square roots of n-gram shares, hashed to FEATURES columns, unit length; number of letters."""
    x, letters = np.zeros((len(texts), FEATURES), np.float32), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        c = _codes(text)
        letters[i] = int((c != 32).sum())
        if not letters[i]:
            continue
        c = np.concatenate([[32], c, [32]]).astype(np.uint32)
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
        three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        h = np.concatenate([one, two, three]) >> np.uint32(32 - 13)
        n = np.bincount(h, minlength=FEATURES)
        x[i] = np.sqrt(n / n.sum())
    return x, letters


@dataclasses.dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """(language, score in 0 to 1) of each text."""
        x, letters = features(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        margin = x @ self.weights + self.bias
        # a bit's loss grows with how far its margin is on the wrong side of the codeword's bit
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ self.trust
        like = np.exp(loss.min(1, keepdims=True) - loss)
        best = loss.argmin(1)
        score = like[np.arange(len(texts)), best] / like.sum(1)
        lang = [self.languages[b] if n else "und" for b, n in zip(best.tolist(), letters.tolist(), strict=True)]
        return lang, np.where(letters > 0, score, 0.0)


def train(texts: list[bytes], labels: list[str], bits: int | None = None, rounds: int = 30, seed: int = 3) -> Model:
    """Logistic classifiers for all bits at once, by mini-batch Adam; two thirds learn, one third weighs the bits."""
    languages = sorted(set(labels))
    bits = bits or code_bits(len(languages))
    code = code_matrix(max(1, len(languages)), bits)
    w, b = np.zeros((FEATURES, bits), np.float32), np.zeros(bits, np.float32)
    if len(languages) < 2:
        return Model(languages, code, w, b, np.ones(bits) / bits)
    x, _ = features(texts)
    y = code[[languages.index(label) for label in labels]].astype(np.float32)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    learn, weigh = order[: max(1, len(order) * 2 // 3)], order[len(order) * 2 // 3 :]
    state = [[np.zeros_like(v) for v in (w, b)] for _ in range(2)]
    step = 0
    for _ in range(rounds):
        for at in np.array_split(rng.permutation(learn), max(1, len(learn) // 64)):
            step += 1
            g = -y[at] / (1 + np.exp(y[at] * (x[at] @ w + b))) / max(1, len(at))
            for k, (v, d) in enumerate(((w, x[at].T @ g + 1e-5 * w), (b, g.sum(0)))):
                m, s = state[0][k], state[1][k]
                m += 0.1 * (d - m)
                s += 0.01 * (d * d - s)
                v -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    margin = x[weigh] @ w + b
    right = ((margin > 0) == (y[weigh] > 0)).mean(0) if len(weigh) else np.full(bits, 0.9)
    trust = np.log(np.clip(right, 0.51, 0.99) / (1 - np.clip(right, 0.51, 0.99)))
    return Model(languages, code, w, b, trust / trust.sum() * 5)


def sample(docs: DataFrame, labels: DataFrame, most: int = MOST, longest: int = LONGEST) -> list[tuple[bytes, str]]:
    """(text, label) of at most `most` documents of each label, those with the least hash of the id; none of over `longest` code points.

    labels: doc_id, label. Ids are chosen first, those with small hashes only, about four times as many as needed; texts are read
    for the chosen ones alone."""
    fits = F.length(F.col("text").cast("string")) <= longest
    there = docs.where(fits & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"))
    marked = there.join(labels.where("label is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("string").alias("label")), "doc_id").withColumn("h", F.xxhash64(F.lit(5), "doc_id"))
    sizes = marked.groupBy("label").agg(F.count("*").alias("n"))  # a row per label
    near = marked.join(F.broadcast(sizes), "label").where(F.col("h") / 2.0**64 + 0.5 <= F.lit(4.0 * most) / F.col("n"))
    chosen = near.select("label", "doc_id", "h").distinct().withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("k") <= most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(fits)
    rows = texts.join(F.broadcast(chosen), "doc_id").select("text", "label", "h").collect()
    return [(r.text.encode(), r.label) for r in sorted(rows, key=lambda r: (r.h, r.label, r.text))]


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    """docs: doc_id, text. labels: doc_id, label."""
    rows = sample(docs, labels, most)
    return train([t for t, _ in rows], [label for _, label in rows])


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shards(batches, rows=512):
            buf, off = flat(b.column("text"))
            data = buf.tobytes()
            lang, score = shared.value.predict([data[x:y] for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pc.less(pa.array(score, pa.float64()), CLEAR)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return id_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def fold(parts: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.col(column).cast("string")) % parts

"""rANS round trips, block images, token files."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairnlake.llm import rans, tokens
from cairnlake.llm.common import written

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=500), min_size=1, max_size=5), st.sampled_from([1, 3, 64]), st.sampled_from([7, 100, rans.PIECE]))
def test_round_trip(blocks, lanes, piece):
    arrays = [np.array(b, np.uint16) for b in blocks if b] or [np.zeros(1, np.uint16)]
    coder = rans.Codec(*rans.quantised(np.bincount(np.concatenate(arrays))))
    coded = coder.encode(arrays, lanes, piece)
    sized = [[(s, w, len(b[k * piece : (k + 1) * piece])) for k, (s, w) in enumerate(p)] for p, b in zip(coded, arrays)]
    back = coder.decode(sized)
    assert all((x == y).all() for x, y in zip(back, arrays))
    for pieces, b in zip(sized, arrays):  # each block alone, and each piece
        assert (coder.decode([pieces])[0] == b).all()
        assert (np.concatenate([coder.decode([[x]])[0] for x in pieces]) == b).all()
        counts, ids = np.array([len(b)]), np.array([5])
        parsed, *columns = rans.parsed(rans.image([(s, w) for s, w, _ in pieces], counts, ids, np.array([False]), piece))
        assert (coder.decode([parsed])[0] == b).all() and [c.tolist() for c in columns] == [[len(b)], [5], [0]]


def test_frequencies():
    for counts in ([0], [0, 5], [1] * 5000, [10**12, 1, 0, 1], []):
        freq, bits = rans.quantised(np.array(counts, np.int64))
        assert freq.sum() == 1 << bits
        assert all((f >= 1) == (c > 0) for f, c in zip(freq, counts)) or not sum(counts)


def test_size_is_near_the_entropy():
    rng = np.random.default_rng(1)
    x = np.minimum(rng.geometric(0.01, 200_000), 2000).astype(np.uint16)
    n = np.bincount(x)
    p = n[n > 0] / n.sum()
    coder = rans.Codec(*rans.quantised(n))
    w = sum(len(w) for _, w in coder.encode([x])[0])
    assert w * 32 < 1.01 * len(x) * -(p * np.log2(p)).sum() + 4 * 64 * 64


def test_damaged_images():
    coder = rans.Codec(*rans.quantised(np.array([3, 4])))
    pieces, = coder.encode([np.array([0, 1, 1], np.uint16)])
    data = rans.image(pieces, np.array([3]), np.array([9]), np.array([False]))
    parsed, counts, ids, null = rans.parsed(data)
    assert (coder.decode([parsed])[0] == [0, 1, 1]).all() and ids[0] == 9 and not null[0]
    for bad in (data[:-1], b"XXXX" + data[4:], data[:10] + b"\x07" + data[11:], b""):
        with pytest.raises(ValueError):
            rans.parsed(bad)


def plain(docs):
    t = Tokenizer.from_file(PATH)
    key = lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or "")
    out, start = [], 0
    for d, x in sorted(docs, key=key):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


ODD = ["<|endoftext|> x<|startoftext|>y", "it's DON'T İstanbul ΣΑΣ ﬁ K", "a　b\x1cc\x85d e", "é ́x", "\x00 \x01", "漢字 😀 👩‍👩‍👧", "123,456.7!? --", "\r\n\t\v\f", "x" * 30_000, "ab " * 20_000, "", None]


def test_ids_equal_the_library(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 500)
    rng = random.Random(1)
    docs = [(i, x) for i, x in enumerate(ODD)] + [(100 + i, " ".join(rng.choice(["word", "Other", "ñandú", "x1", "end."]) for _ in range(rng.randrange(300)))) for i in range(60)] + [(None, "none"), (5, "again"), (5, "again")]
    got = tokens.round_trip(spark.createDataFrame(docs, SCHEMA).repartition(4), PATH, 1).collect()
    rows = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1])
    assert rows == plain(docs)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)


def test_few_kept_words(spark, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 3)
    encoder = tokens._Encoder(PATH, False)
    import pyarrow as pa

    for text in ["a b c d e", "e f g", "a b a b h i j k", "a h z"] * 2:
        symbols, bounds = encoder.encode(pa.array([text, text]))
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert symbols[: bounds[1]].tolist() == want == symbols[bounds[1] :].tolist()


def thue_morse(n, a, b):
    for _ in range(n):
        a, b = a + b, b + a
    return a


def test_words_that_cancel_out_in_polynomials(spark):
    """Hashes that are polynomials modulo 2^64 take these two words for one, whatever the base."""
    docs = [(1, thue_morse(12, "a", "b")), (2, thue_morse(12, "b", "a"))]
    got = tokens.round_trip(spark.createDataFrame(docs, SCHEMA).coalesce(1), PATH, 1).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == plain(docs)


def test_words_that_share_a_hash(monkeypatch):
    import pyarrow as pa

    hashes = tokens.span_hash
    monkeypatch.setattr(tokens, "span_hash", lambda *a, **b: (np.full(len(a[1]), 7, np.uint64), hashes(*a, **b)[1]))
    encoder = tokens._Encoder(PATH, False)
    symbols, _ = encoder.encode(pa.array(["two words share one hash"]))
    assert symbols.tolist() == encoder.tokenizer.encode("two words share one hash", add_special_tokens=False).ids


def test_a_very_long_document_takes_bounded_memory():
    """2,000,000 words: its ids, and pieces of constant size beside them."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(2)
    some = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 8))) for _ in range(1000)) for _ in range(20)]
    text = " ".join(some[i % 20] for i in range(2000))
    encoder = tokens._Encoder(PATH, False)
    want = [i for i in range(20) for i in encoder.tokenizer.encode(some[i], add_special_tokens=False).ids]
    column = pa.array([text, "short"])
    tracemalloc.start()
    symbols, bounds = encoder.encode(column)
    assert symbols[: len(want)].tolist() == want and bounds[1] == 100 * len(want)
    coder = rans.Codec(*rans.quantised(np.bincount(symbols)))
    coded = coder.encode([symbols, symbols[:5]])
    back = coder.decode([[(s, w, min(rans.PIECE, len(x) - k * rans.PIECE)) for k, (s, w) in enumerate(p)] for p, x in zip(coded, [symbols, symbols[:5]])])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (back[0] == symbols).all() and (back[1] == symbols[:5]).all()
    assert len(symbols) > 4_000_000 and peak < 40 * len(symbols) + (100 << 20)


def test_tokenizers_whose_pieces_hold_white_space_need_whole_texts():
    with pytest.raises(ValueError, match="whole=True"):
        tokens._Encoder(public_tokenizers.path("byte_bpe_50k.json"), False)


def test_other_tokenizer_whole(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = [(i, x) for i, x in enumerate(ODD[1:8])]
    t = Tokenizer.from_file(path)
    got = tokens.round_trip(spark.createDataFrame(docs, SCHEMA), path, 50256, whole=True).collect()
    for r in got:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == [*t.encode(docs[r.doc_id][1], add_special_tokens=False).ids, 50256]


def test_empty_table_and_row_order(spark):
    assert tokens.round_trip(spark.createDataFrame([], SCHEMA), PATH, 1).count() == 0
    assert tokens._Encoder(PATH, False)._ids([])[0].size == 0
    docs = written(spark.createDataFrame([(3, "c"), (1, "a b"), (2, "d"), (None, "e")], SCHEMA + "").withColumn("start", F.lit("clash")).coalesce(1))
    rows = tokens.round_trip(docs, PATH, 1, order="rows").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [3, 1, 2, None] and [r.start for r in rows] == [0, 2, 5, 7]

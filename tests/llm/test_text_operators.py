"""Decontamination, PII, fingerprints, substring dedup, licenses and mixing on small tables with hard cases."""

import hashlib
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cairnlake.llm import decontaminate, licenses, mixing, pii, substring_dedup, winnowing

SCHEMA = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "É ñ 1"), (5, "a" * 50_000), (6, "w " * 30_000), (None, "null id"), (7, "same"), (7, "same")]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
words = lambda t: re.findall(WORD, (t or "").translate(UPPER))


# decontamination


def brute_hits(text, items, window=10):
    w, hit, found, longest = words(text), set(), set(), 0
    for name, item in items:
        iw = words(item)
        if not iw or name is None:
            continue
        n = min(window, len(iw))
        for i in range(len(iw) - n + 1):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == iw[i : i + n]:
                    hit.update(range(p, p + n))
                    found.add(name)
        for i in range(len(iw)):
            for p in range(len(w)):
                k = 0
                while i + k < len(iw) and p + k < len(w) and iw[i + k] == w[p + k]:
                    k += 1
                longest = max(longest, k if k >= n else 0)
    return len(w), len(hit), sorted(found), longest


def contaminated_set(rng):
    items = [(str(i), " ".join(rng.choice("abcde") * rng.randrange(1, 3) for _ in range(rng.choice([3, 9, 10, 14, 40])))) for i in range(12)]
    docs = []
    for d in range(30):
        parts = [rng.choice("abcdefg") for _ in range(rng.randrange(60))]
        if d % 3 == 0:
            parts += [rng.choice(items)[1]]
        docs.append((d, " ".join(parts).title() if d % 2 else ", ".join(parts)))
    return docs, items


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 20), (2, 300)])
def test_decontamination_equals_brute_force(spark, seed, block):
    docs, items = contaminated_set(random.Random(seed))
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.report(spark.createDataFrame(docs, SCHEMA), bench, block_bytes=block).collect()
    assert len(got) == len(docs)
    for r in got:
        n, hit, found, longest = brute_hits(dict(docs)[r.doc_id], items)
        assert (r.n_words, r.n_hit, list(r["items"]), r.longest, r.contaminated) == (n, hit, found, longest, hit > 0)
        assert sum(b - a for a, b in r.spans) == hit
        for m in r.matches:  # verbatim, and no longer
            w, iw = words(dict(docs)[r.doc_id]), words(dict(items)[m.item])
            part = w[m.start : m.start + m.words]
            assert any(iw[i : i + m.words] == part and (i == 0 or m.start == 0 or iw[i - 1] != w[m.start - 1]) and (i + m.words == len(iw) or m.start + m.words == len(w) or iw[i + m.words] != w[m.start + m.words]) for i in range(len(iw)))


def brute_matches(text, items, window=10):
    """The longest match at each place, unless the one of the place before holds it."""
    w, best = words(text), {}
    for _, item in items:
        iw = words(item)
        for i in range(len(iw)):
            for p in range(len(w)):
                k = 0
                while i + k < len(iw) and p + k < len(w) and iw[i + k] == w[p + k]:
                    k += 1
                if iw and k >= min(window, len(iw)):
                    best[p] = max(best.get(p, 0), k)
    return sorted((p, k) for p, k in best.items() if best.get(p - 1, 0) <= k)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_longest_matches_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    docs, items = contaminated_set(rng)
    items += [("rep", "a " * 25), ("rep2", "b " * 4 + "a " * 12), ("two", "a b " * 9)]
    docs += [(100, "a " * 40), (101, "c " + "a " * 30 + "b " + "a " * 11), (102, "b a " * 20), (103, "b b b b " + "a " * 14 + "d")]
    got = decontaminate.report(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id string, text string")).collect()
    for r in got:
        assert sorted((m.start, m.words) for m in r.matches) == brute_matches(dict(docs)[r.doc_id], items)


def test_repetitive_texts_take_bounded_work():
    """100,000 equal words against an item of 1,000, and 2,000 items that share their windows."""
    import time
    import tracemalloc

    import pyarrow as pa

    items = [("a", "x " * 1000), *((f"b{i}", "common words of every item one two three four five " + "x " * 20 + str(i)) for i in range(2000))]
    query = decontaminate.Suffixes([(n, w) for (n, _), w in zip(items, decontaminate.item_words([t for _, t in items]))])
    texts = pa.array(["x " * 100_000, "y " + "common words of every item one two three four five x x " * 300])
    began = time.time()
    tracemalloc.start()
    n, spans, found, matches = decontaminate._search_shard(texts, query)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert time.time() - began < 60 and peak < 300 << 20
    assert n.tolist() == [100_000, 3601] and spans == [[(0, 100_000)], [(1, 3601)]]
    assert len(found[0]) == 2001 and len(found[1]) == 2000
    assert max(m["words"] for m in matches[0]) == 1000 and len(matches[0]) <= 100_000


def test_words_that_cancel_out_in_polynomials(spark):
    """Thue-Morse words and their complements, which hashes modulo 2^64 take for one."""
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    docs = spark.createDataFrame([(1, a), (2, b)], SCHEMA)
    bench = spark.createDataFrame([("x", a)], "item_id string, text string")
    assert {r.doc_id: r.contaminated for r in decontaminate.report(docs, bench).collect()} == {1: True, 2: False}


def test_decontamination_edge_cases(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    bench = spark.createDataFrame([("a", "same"), ("b", None), (None, "same"), ("c", ""), ("a", "null id")], "item_id string, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.report(docs, bench).collect())
    assert got == [(0, 2, 2, ("a",)), (1, 0, 0, ()), (2, 0, 0, ()), (3, 0, 0, ()), (4, 3, 0, ()), (5, 1, 0, ()), (6, 30_000, 0, ()), (7, 1, 1, ("a",)), (7, 1, 1, ("a",))]
    assert decontaminate.report(docs, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.report(docs.where("false"), bench).count() == 0
    clash = spark.createDataFrame([(1, "same", 3, "t", 1, 2), (2, "x", 4, None, 1, 2)], SCHEMA + ", item_id long, _text string, _found int, `a.b` int")
    kept = decontaminate.clean(clash, bench)
    assert kept.columns == clash.columns and [r.doc_id for r in kept.collect()] == [2]
    assert [r.doc_id for r in decontaminate.clean(clash, bench, block_bytes=4).collect()] == [2]


def test_items_without_an_id_hit(spark):
    docs = spark.createDataFrame([(1, "before the passage after"), (2, "named item here"), (3, "neither")], SCHEMA)
    bench = spark.createDataFrame([(None, "the passage"), ("a", "named item"), (None, None)], "item_id string, text string")
    for block in (1 << 20, 4):
        got = {r.doc_id: (r.n_hit, r.n_items, list(r["items"]), r.longest, r.contaminated) for r in decontaminate.report(docs, bench, block_bytes=block).collect()}
        assert got == {1: (2, 0, [], 2, True), 2: (2, 1, ["a"], 2, True), 3: (0, 0, [], 0, False)}
        assert [r.doc_id for r in decontaminate.clean(docs, bench, block_bytes=block).collect()] == [3]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.integers(1, 12))
def test_suffix_array_sorts_suffixes(values, depth):
    import numpy as np

    h = np.array(values, np.uint64)
    sa = decontaminate.suffix_array(h, depth)
    assert sorted(sa.tolist()) == list(range(len(values)))
    keys = [tuple(values[i : i + depth]) for i in sa.tolist()]
    assert keys == sorted(keys)


# personal data

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or "", re.A):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def check_spans(spark, docs):
    got = pii.report(spark.createDataFrame(docs, SCHEMA)).collect()
    want = sorted((d is not None, d or 0, brute_spans(t)) for d, t in docs)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.base) for r in got) == want
    for r in got:
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == [s for s in r.base.split(",") if s]
        assert r.n_email == r.base.count("email:") and r.n_card == r.base.count("card:")


def test_pii_patterns(spark):
    texts = [
        "a@b.c x.y+z@q-1.de, a@b.c%d@e.f @x.y a@b a@b. é@b.c", "1.2.3.4 256.1.1.1 1.2.3.4.5 001.002.003.004 0000255.1.1.1 9999999999999.1.1.1 1.2.3",
        "4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112 41111111111111111111111 1 2 3 4  4 4111  1111 1111 1111", "+1 (988) 555-2485 +1 2 ++4912345678 +123 +1234567890123456 +1.2.3.4.5.6.7.8.9", "😀 mail me@x.org 😀 1.1.1.1 and +1 234 567 8901 4111111111111111 é",
    ]
    check_spans(spark, [*enumerate(texts, 100), *ODD, (50, "1 " * 9000), (51, "1" * 20_000), (52, "a" * 9000 + "@" + "b." * 9000), (53, "1." * 9000), (54, "+1" + "(" * 9000)])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789a@.+- (%é\n", max_size=60), min_size=20, max_size=60))
def test_pii_random(spark, texts):
    check_spans(spark, list(enumerate(texts)))


def test_disclosing_terms(spark):
    """`zorblax` stands in no document without the address; `common` is everywhere."""
    docs = [(i, f"write common zorblax at me@x.org or common {i}") for i in range(3)] + [(10 + i, f"common words number{i}") for i in range(200)]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(docs, SCHEMA)).collect()}
    text = docs[0][1]
    at = text.index("zorblax")
    assert f"term:{at}:{at + 7}" in got[0].spans.split(",") and got[10].spans == ""
    c = text.index("common")
    assert f"term:{c}:{c + 6}" not in got[0].spans
    clean = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert "zorblax" not in clean[0] and "[EMAIL]" in clean[0] and "common" in clean[0] and clean[10] == docs[3][1]
    assert pii.report(spark.createDataFrame([], SCHEMA)).count() == 0
    one = pii.report(spark.createDataFrame([(1, "me@x.org word")], SCHEMA)).first()
    assert one.spans == "email:0:8"


def test_disclosing_terms_go_wherever_they_stand(spark):
    """Far from the entity, in texts without it, in any case; not where a word touches a base span."""
    near = [(i, f"write zorblax at me@x.org {i}") for i in range(9)]
    far = [(20, "me@x.org " + "far " * 100 + "and Zorblax"), (21, "ZORBLAX alone, zorblaxian not"), (22, "zorblax@y.org"), (22, "zorblax@y.org")]
    docs = near + far + [(100 + i, f"some words number{i}") for i in range(400)]
    got = {}
    for r in pii.report(spark.createDataFrame(docs, SCHEMA)).collect():
        got.setdefault(r.doc_id, set()).add(r.spans)
    assert got[20] == {f"email:0:8,term:{9 + 400 + 4}:{9 + 400 + 11}"}
    assert got[21] == {"term:0:7"}
    assert got[22] == {"email:0:13"}
    clean = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert clean[21].lower() in (" alone, zorblaxian not", "[term] alone, zorblaxian not") and clean[22] == "[EMAIL]"
    assert clean[100] == docs[13][1]


def test_many_spans_in_one_text_take_linear_work(spark):
    """20,000 addresses, and one text of a million code points."""
    import time

    text = " ".join(f"word{i % 7} user{i}@host.org" for i in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, "x" * 500_000 + " 1.2.3.4 " + "é " * 250_000), (3, None)], SCHEMA + "").selectExpr("*", "'t' as h", "'u' as base", "1 as rid")
    began = time.time()
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert (got[1].n_email, got[2].n_ip, got[3].spans) == (20_000, 1, "")
    assert time.time() - began < 240


def test_very_long_texts_are_sanitised(spark):
    long = "x" * 500_000 + " 1.2.3.4 " + "é " * 250_000
    docs = spark.createDataFrame([(1, " ".join(f"user{i}@host.org" for i in range(3000))), (2, long)], SCHEMA)
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[1] == " ".join(["[EMAIL]"] * 3000) and clean[2] == long.replace("1.2.3.4", "[IP]")


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789a@.+- é\n", max_size=1500), min_size=5, max_size=12))
def test_sanitised_equals_a_plain_loop(spark, texts):
    got = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(list(enumerate(texts)), SCHEMA), support=10**6).collect()}
    for i, text in enumerate(texts):
        out, at = "", 0
        for span in filter(None, brute_spans(text).split(",")):
            kind, start, end = span.split(":")
            if int(start) >= at:
                out += text[at : int(start)] + f"[{kind.upper()}]"
            at = max(at, int(end))
        assert got[i] == out + text[at:]


# fingerprints


def plain_fingerprint(text, k, w):
    mask, base = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def h(t):
        v = 0
        for c in t:
            v = (v * base + ord(c) + 1) & mask
        for a, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            v ^= v >> a
            v = v * m & mask
        return v >> 33

    grams = [h(text[i : i + k]) for i in range(max(1, len(text) - k + 1))] if text else []
    out = []
    for i in range(max(1, len(grams) - w + 1)) if grams else ():
        win = grams[i : i + w]
        p = i + max(j for j, x in enumerate(win) if x == min(win))
        if not out or out[-1][1] != p:
            out.append((grams[p], p))
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab é😀", max_size=80), min_size=1, max_size=6), st.sampled_from([(3, 4), (5, 6), (16, 48), (7, 1)]))
def test_fingerprints_equal_plain_ones(texts, shape):
    import numpy as np
    import pyarrow as pa

    hashes, places, bounds = winnowing.fingerprints(winnowing.code_points(pa.array(texts)), *shape)
    for i, t in enumerate(texts):
        got = list(zip(hashes[bounds[i] : bounds[i + 1]].tolist(), places[bounds[i] : bounds[i + 1]].tolist()))
        assert got == plain_fingerprint(t, *shape)
    assert isinstance(bounds, np.ndarray)


def test_shared_passages_share_a_fingerprint(spark):
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(winnowing.K + winnowing.WINDOW - 1))
    a, b = ("".join(rng.choice("xyz ") for _ in range(300)) for _ in range(2))
    got = {r.doc_id: r for r in winnowing.winnow(spark.createDataFrame([(1, a + passage), (2, passage + b)], SCHEMA)).collect()}
    assert set(got[1].hashes) & set(got[2].hashes)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_edited_texts_take_the_next_document(spark, parts):
    docs = [(i * 3 % 41, f"text {i} " * (i % 9)) for i in range(41)] + [(None, "last of all"), (100, None), (101, "é😀" * 30)]
    got = {r.doc_id: r for r in winnowing.compared(spark.createDataFrame(docs, SCHEMA).repartition(3), parts).collect()}
    order = sorted((d for d in docs if d[0] is not None), key=lambda d: -d[0]) + [(None, "last of all")]
    assert len(got) == len(docs)
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        assert got[d].edited == t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] and got[d].n_chars == len(t)
        a, b = ({h for h, _ in plain_fingerprint(x, winnowing.K, winnowing.WINDOW)} for x in (t, nxt))
        assert got[d].near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_one_document_and_none(spark):
    one = winnowing.compared(spark.createDataFrame([(5, "abcdef")], SCHEMA), 4).collect()
    assert [(r.doc_id, r.edited, r.near_next) for r in one] == [(5, "abcabc", 1.0)]
    assert winnowing.compared(spark.createDataFrame([], SCHEMA), 4).count() == 0
    assert winnowing.compared(spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], SCHEMA), 4).count() == 3


# substring dedup


def plain_sentences(text):
    tokens = re.findall(r"[^\x20\x09-\x0D]+|\n", (text or "").translate(UPPER))
    ws = [t for t in tokens if t != "\n"]
    key = [(sum(w.encode()) * 40503 + len(w.encode()) * 10007) % 65536 for w in ws]
    out, cur, i = [], [], 0
    for t in tokens:
        if t == "\n":
            out, cur = (out + [cur] if cur else out), []
            continue
        cur.append(t)
        if t[-1] in ".!?" or key[i] == min(key[max(0, i - 2) : i + 3]):
            out, cur = out + [cur], []
        i += 1
    return [" ".join(s) for s in out + ([cur] if cur else [])]


def check_spans_removed(spark, docs, run=substring_dedup.RUN):
    got = {r.doc_id: r for r in substring_dedup.report(spark.createDataFrame(docs, SCHEMA), run).collect()}
    sents = {d: plain_sentences(t) for d, t in docs}
    first, gone = {}, {d: set() for d in sents}
    for d in sorted(sents):
        n = len(sents[d])
        for p in range(max(1, n - run + 1) if n else 0):
            key = tuple(sents[d][p : p + run])
            if key in first:
                gone[d].update(range(p, min(p + run, n)))
            first.setdefault(key, (d, p))
    for d, s in sents.items():
        left = " ".join(x for i, x in enumerate(s) if i not in gone[d])
        assert (got[d].n_sentences, got[d].n_removed) == (len(s), len(gone[d]))
        assert got[d].kept_sha256 == hashlib.sha256(left.encode()).hexdigest()
        assert " ".join(re.findall(r"[^\x20\x09-\x0D]+", (got[d].text or "").translate(UPPER))) == left


def test_a_passage_goes_wherever_it_stands(spark):
    """51 words without punctuation, and 51 in sentences, at any place between other words."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 11)))
    plain = " ".join(word() for _ in range(51))
    prose = ". ".join(" ".join(word() for _ in range(n)) for n in (13, 14, 12, 12)) + "."
    docs = [(i, " ".join([*(word() for _ in range(rng.randrange(40))), (plain, prose)[i % 2], *(word() for _ in range(rng.randrange(40)))])) for i in range(60)]
    docs += [(100 + i, " ".join(word() for _ in range(200))) for i in range(20)]
    check_spans_removed(spark, docs)
    for r in substring_dedup.report(spark.createDataFrame(docs, SCHEMA)).collect():
        left = set((r.text or "").split())
        if r.doc_id >= 100:
            assert r.n_removed == 0
        elif r.doc_id >= 2:
            assert len(left & set((plain, prose)[r.doc_id % 2].split())) <= 24


def test_sentences_that_cancel_out_in_polynomials(spark):
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    assert all(r.n_removed == 0 for r in substring_dedup.report(spark.createDataFrame([(1, a), (2, b), (3, " ".join(a)), (4, " ".join(b))], SCHEMA)).where("doc_id in (1, 2)").collect())
    check_spans_removed(spark, [(1, a), (2, b), (3, " ".join(a)), (4, " ".join(b))])


def test_repeated_passages_go(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 12)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice([".", "!", "?", "\n"])
    passages = [" ".join(sentence(rng.randrange(3, 12)) for _ in range(6)) for _ in range(4)] + [" ".join(word() for _ in range(70))]
    docs = [(i, " ".join([sentence(5), *(rng.choice(passages) for _ in range(rng.randrange(3))), sentence(rng.choice([4, 40]))])) for i in range(40)]
    check_spans_removed(spark, docs)
    check_spans_removed(spark, docs, 2)


def test_substring_edge_cases(spark):
    docs = [(d, t) for d, t in ODD if d is not None and d != 7] + [(20, "One. Two."), (21, "one.  two."), (22, "One. Two. Three."), (23, "a. a. a. a. a. a."), (24, "b. " * 100_000)]
    check_spans_removed(spark, docs)
    got = substring_dedup.report(spark.createDataFrame([(None, "x y."), (1, "x y."), (7, "same"), (7, "same")], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 2), (1, 0), (7, 0), (7, 0)]
    assert substring_dedup.report(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = "places int, _doc int, _places string, _text string, _row int, `a.b` int"
    wide = spark.createDataFrame([(1, "A. B. C. D.", 1, 1, "p", "t", 4, 5), (2, "A. B. C. D. E.", 2, 2, "p", "t", 4, 5), (3, None, 3, None, None, None, None, None)], f"{SCHEMA}, {clash}")
    out = substring_dedup.deduplicated(wide)
    assert out.columns == wide.columns and {r.doc_id: r.text for r in out.collect()} == {1: "A. B. C. D.", 2: "E.", 3: None}
    assert {r["a.b"] for r in out.collect()} == {5, None}


# licenses


def brute_blocks(text):
    w = words(text)
    return [set(w[i : i + 64]) for i in range(0, len(w), 32)]


def brute_licenses(text):
    """(n_words, n_base, first, last, base labels, all labels, score)."""
    w, places, labels = words(text), [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    met = []
    for block in brute_blocks(text):
        for label, statement in licenses.TEMPLATES:
            t, (must, mustnt) = set(words(statement)), licenses.MARKS[label]
            if 10 * len(t & block) >= 8 * len(t) and must in block and mustnt not in block:
                met.append((label, len(t & block) / len(t)))
    return len(w), len(places), min(places, default=None), max(places, default=None), sorted(labels), sorted(labels | {x for x, _ in met}), 1.0 if places else max([c for _, c in met], default=0.0)


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [w for _, t in licenses.TEMPLATES for w in words(t)] + ["noise"] * 20
    lines = [t.title() for _, t in licenses.TEMPLATES] + [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(5)))) for i in range(100, 180)] + ODD
    docs += [(90, "Under  the-MIT license; under the mit license. Underthe mit license"), (91, "CC BY-NC"), (92, "Apache License, Version 2.0"), (93, "Kind under the mit licenseé"), (94, "wor\u212a under the mit license \u0130"), (95, "x " * 40_000 + "under the mit license " + "y " * 40_000)]
    clash = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as w", "2 as rid", "3 as n_words", "4 as blocks")
    got = licenses.scanned(clash).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, str(r))
    mine = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, list(r.base), list(r.labels), round(r.score, 9)) for r in got), key=key)
    want = sorted(((d, *brute_licenses(t)[:-1], round(brute_licenses(t)[-1], 9)) for d, t in docs), key=key)
    assert mine == want
    assert licenses.scanned(spark.createDataFrame([], SCHEMA)).count() == 0


def test_license_statements_in_their_usual_layout(spark):
    """Headers that wrap, one license each; and statements that differ from a template in the word that matters."""
    texts = {
        "isc": "Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted, provided that",
        "bsd-3": "Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that",
        "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy",
        "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
        "agpl-3": "Licensed under the GNU Affero General\n\nPublic License version 3",
        "": "Released under the BSD License. Licensed under CC BY 4.0.",
    }
    docs = [(i, t) for i, t in enumerate(texts.values())] + [(50 + i, " ".join(["word"] * (31 + 7 * i)) + " " + t) for i, t in enumerate(texts.values())]
    got = {r.doc_id: ",".join(r.labels) for r in licenses.scanned(spark.createDataFrame(docs, SCHEMA)).collect()}
    for i, label in enumerate(texts):
        assert got[i] == label and got[50 + i] == label


def test_the_positional_filter_removes_candidates(spark):
    order = ["a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k", "l"]
    prefix = licenses.prefixes(spark, order, [("one", "a b c d e f g h i j")], 0.8)  # need 8, prefix a b c
    rows = [("meets", list("abcdefgh")), ("late", list("cdefghijkl")), ("behind", list("bcdefgkl")), ("few", list("abc"))]
    blocks = spark.createDataFrame(rows, "rid string, words array<string>").selectExpr("*", "0 as block")
    loose = {(r.rid, r.word) for r in licenses.candidates(blocks, prefix, positional=False).select("rid", "word").collect()}
    tight = {(r.rid, r.word) for r in licenses.candidates(blocks, prefix).select("rid", "word").collect()}
    assert loose == {("meets", "a"), ("meets", "b"), ("meets", "c"), ("late", "c"), ("behind", "b"), ("behind", "c")}
    assert tight == {("meets", "a"), ("late", "c"), ("behind", "b")}
    assert {(r.rid, r.containment) for r in licenses.containment_join(blocks, prefix).collect()} == {("meets", 0.8), ("late", 0.8)}


# mixing


def test_mixing_keeps_every_source_within_a_block(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["a"] * 6 + ["b"] * 3 + ["c", None])) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, source string").repartition(5)
    for weights in (None, {"a": 0.5, "b": 0.3, "c": 0.15}):
        got = mixing.mixed(df, weights, period=100, block=4).collect()
        assert sorted(r.position for r in got) == list(range(3000))
        counts = sorted({(s or "", sum(1 for _, x in docs if x == s)) for s in {x for _, x in docs}})
        a, period = mixing.shares(counts, weights, 100)
        assert sum(a) == period
        share = {s: w / period for (s, _), w in zip(counts, a)}
        slots = {}
        for r in got:
            slots.setdefault(r.slot, set()).add((r.source or "", r.block))
        assert all(len(x) == 1 for x in slots.values())
        blocks = {s: -(-n // 4) for s, n in counts}
        served = dict.fromkeys(share, 0)
        for t in range(max(slots) + 1):
            for s, w in share.items():  # less than one block from the share, until the source is used up
                if served[s] < blocks[s]:
                    assert abs(served[s] - w * t) < 1
            for s, b in slots.get(t, ()):
                assert b == served[s]
                served[s] += 1
        order = sorted(got, key=lambda r: r.position)
        assert [r.slot for r in order] == sorted(r.slot for r in got)
        for s in share:
            assert [r.doc_id for r in order if (r.source or "") == s] == sorted(d for d, x in docs if (x or "") == s)


def test_mixing_edge_cases(spark):
    schema = "doc_id long, source string, position string"
    assert mixing.mixed(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "x", "p"), (1, "x", "p"), (None, None, None)], schema)
    assert sorted(r.position for r in mixing.mixed(df).collect()) == [0, 1, 2]
    out = mixing.in_mixed_order(df)
    assert out.columns == df.columns and out.count() == 3

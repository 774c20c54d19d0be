"""MinHash near-dedup against brute force over all pairs."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnlake.llm import graph, near_dedup

SCHEMA = "doc_id long, text string"
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs, percent):
    sets = {d: shingles(t) for d, t in docs if d is not None}
    root = {d: d for d in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), find(d)) for d in sets}


def check(spark, docs, percent=85):
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, SCHEMA), percent).collect()
    assert len(got) == len(docs)
    want = brute(docs, percent)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**9)}"
    return " ".join(out)


@pytest.mark.parametrize("percent", [80, 85])
def test_families_of_edits(spark, percent):
    """Copies with edits that put them on both sides of the threshold, a chain, exact copies, unrelated texts."""
    rng = random.Random(percent)
    docs, n = [], 0
    for family in range(6):
        base = [f"f{family}w{rng.randrange(5000)}" for _ in range(rng.choice([30, 80, 300]))]
        for k in range(25):
            docs.append((n, edited(base, k % 7, rng)))
            n += 1
    chain = [f"c{i}" for i in range(200)]
    for k in range(20):
        chain[k * 9] = f"x{k}"
        docs.append((n, " ".join(chain)))
        n += 1
    docs += [(n + i, "same text of seven words it is") for i in range(30)]
    rng.shuffle(docs)
    check(spark, docs, percent)


def test_blocks_smaller_than_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "SALT", 5)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    check(spark, [(i, edited(base, 1 + i % 6, rng)) for i in range(60)])


def test_edge_cases(spark):
    check(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (6, "a b c d"), (7, "a b c d"), (8, "a b c d e"), (9, " x"), (None, "a"), (10, "x " * 20_000), (11, "x " * 19_000)])


def test_empty_table_and_clashing_columns(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 5), (2, "a b c d e f", None, 6), (3, "other words", "y", 7)], SCHEMA + ", node string, kept int").selectExpr("*", "1 as _gone", "2 as _row", "3 as _id", "4 as `a.b`")
    kept = near_dedup.near_dedup(docs, 80)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3}


def test_repeated_rows(spark):
    got = near_dedup.near_duplicates(spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a b")], SCHEMA)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False)]


def test_texts_that_share_an_id_are_judged_alone(spark):
    """Id 5 has a copy of 3's text, a text of its own that 8 copies, and one that nearly equals 9's; 7 repeats itself, 6 is without words."""
    long = [f"w{i}" for i in range(60)]
    docs = [(3, "a b c d e f"), (5, "a b c d e f"), (5, "own words of five"), (5, "OWN words of five"), (8, "own words of five"), (5, " ".join(long)), (9, " ".join([*long, "end"])), (7, "x y z"), (7, "x y z"), (5, ""), (6, ""), (None, "x y z"), (None, "x y z")]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], SCHEMA + ", extra int").repartition(3)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(frame, 80).collect())
    assert got == sorted([(3, 2, 3, True), (5, 2, 3, False), (5, 1, 5, True), (5, 1, 5, True), (8, 1, 5, False), (5, 56, 5, True), (9, 57, 5, False), (7, 1, 7, True), (7, 1, 7, True), (5, 0, 5, True), (6, 0, 6, True), (0, 1, 0, True), (0, 1, 0, True)])
    kept = near_dedup.near_dedup(frame, 80)
    assert kept.columns == frame.columns
    left = sorted((r.doc_id or 0, r.text.lower()) for r in kept.collect())
    assert left == sorted([(3, "a b c d e f"), (5, "own words of five"), (5, " ".join(long)), (7, "x y z"), (5, ""), (6, ""), (0, "x y z"), (0, "x y z")])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n", max_size=30), min_size=1, max_size=25))
def test_random_small_texts(spark, texts):
    check(spark, list(enumerate(texts)))


def exact_join(docs, percent):
    """Links between different texts by a prefix filter over words sorted by how rare their shingles are: (smallest ids of both texts)."""
    from collections import Counter, defaultdict

    classes = {}
    for d, t in sorted(docs):
        if s := shingles(t):
            classes.setdefault(s, d)
    freq = Counter(x for s in classes for x in s)
    index, links, checked = defaultdict(list), set(), set()
    for s, d in sorted(classes.items(), key=lambda c: len(c[0])):
        order = sorted(s, key=lambda x: (freq[x], x))
        prefix = order[: len(s) - -(-len(s) * percent // 100) + 1]
        for x in prefix:
            for o, od in index[x]:
                if (od, d) not in checked and 100 * len(o) >= percent * len(s):
                    checked.add((od, d))
                    if 100 * len(s & o) >= percent * len(s | o):
                        links.add((min(d, od), max(d, od)))
        for x in prefix:
            index[x].append((s, d))
    return classes, links


@pytest.mark.parametrize("percent", [80, 85])
def test_components_equal_an_exact_join_over_all_documents(spark, percent):
    """Recall over sf0.1 (10,000 documents): every component is that of the exact join."""
    frame = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    docs = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    classes, links = exact_join(docs, percent)
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in sorted(links):
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    want = {d: find(classes[s]) if (s := shingles(t)) else d for d, t in docs}
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame, percent).collect()}
    assert got == want and len(links) == {80: 48, 85: 14}[percent]


def test_words_that_cancel_out_in_polynomials(spark):
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    check(spark, [(1, a), (2, b), (3, f"{a} x y z u v"), (4, f"{b} x y z u v")])


def test_no_pair_at_the_threshold_is_missed_by_bands():
    for percent in (80, 85, 90):
        rows, bands = near_dedup.band_shape(percent)
        assert (1 - (percent / 100) ** rows) ** bands < 1e-8 and rows * bands <= near_dedup.BINS


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    star = spark.range(1, 500).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert {r.component for r in graph.components(star).collect()} == {0}


def test_joins_are_broadcast_only_where_a_hint_says_so(spark, monkeypatch):
    plain, over = near_dedup.written, []

    def spied(df, *more):
        df.collect()
        run = df._jdf.queryExecution()
        final = run.executedPlan().toString().split("== Initial Plan ==")[0]
        made = sum("BroadcastExchange" in line and "ReusedExchange" not in line for line in final.split("\n"))
        over.append(made - run.optimizedPlan().toString().count("strategy=broadcast"))
        return plain(df, *more)

    monkeypatch.setattr(near_dedup, "written", spied)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    docs = [(i, " ".join(f"w{i % 7}x{j}" for j in range(40)) + f" {i % 3}") for i in range(60)]
    got = near_dedup.near_dedup(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted(r.doc_id for r in got) == sorted({c for _, c in brute(docs, 80).values()})
    assert len(over) > 5 and max(over) <= 0
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before

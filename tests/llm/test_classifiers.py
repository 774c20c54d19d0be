"""Held-out accuracy and hard cases of language identification and the toxicity classifier."""

import math
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnlake.llm import language_id, queries, toxicity

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"
HARD = [(1, None), (2, ""), (3, "123 !? \n"), (4, "x"), (5, "é" * 30_000), (6, "漢字"), (8, "😀😀"), (9, "🀄 🎲"), (10, "𝟙𝟚𝟛 𝟜 ٣"), (11, "𝐚𝐛 😀"), (12, "the " * 20_000), (None, "the and of"), (7, "a"), (7, "a")]


@pytest.fixture(scope="module")
def languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return language_id.fit(docs, docs.where(language_id.fold(3) != 1).select("doc_id", F.col("lang").alias("label")))


def test_codewords_differ():
    for n in (2, 4, 9):
        code = language_id.code_matrix(n)
        assert min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)) >= 4
        assert (abs(code.sum(0)) < n).all()


def test_codes_grow_with_the_languages():
    import time

    began = time.time()
    code = language_id.code_matrix(50, language_id.code_bits(50))
    assert time.time() - began < 2
    assert min(int((code[i] != code[j]).sum()) for i in range(50) for j in range(i)) >= 7


def test_decoding_equals_a_plain_loop():
    import math

    import numpy as np

    rng = np.random.default_rng(2)
    texts = [(" ".join(rng.choice(["aa", "bee", "cé", "dada", "eu"], 8)) + f" {lang * 3}").encode() for lang in "xyz" for _ in range(20)]
    model = language_id.train(texts, ["x"] * 20 + ["y"] * 20 + ["z"] * 20, rounds=3)
    got, score = model.predict(texts)
    x, _ = language_id.features(texts)
    for i in range(len(texts)):
        margin = [sum(float(x[i, f]) * float(model.weights[f, b]) for f in np.flatnonzero(x[i])) + float(model.bias[b]) for b in range(model.code.shape[1])]
        loss = [sum(math.log1p(math.exp(-m * c)) * t for m, c, t in zip(margin, word, model.trust)) for word in model.code]
        best = min(range(3), key=loss.__getitem__)
        assert got[i] == model.languages[best]
        assert abs(score[i] - math.exp(-loss[best]) / sum(math.exp(-v) for v in loss)) < 1e-4


def test_clashing_columns_are_ignored(spark, languages):
    docs = spark.createDataFrame([(1, "the and of", "fr", 0.5), (1, "the and of", "fr", 0.5)], SCHEMA + ", lang_pred string, score double")
    assert [r.lang_pred for r in language_id.identified(docs, languages).collect()] == ["en", "en"]


def test_wrong_bits_are_corrected(languages):
    """With one classifier's bit turned round, texts still decode to their language."""
    import dataclasses

    texts = [b"the and of the that with", "de la que el los cioñ".encode(), b"der die und nicht ein", "le la des éaux que".encode()] * 3
    want = languages.predict(texts)[0]
    bent = dataclasses.replace(languages, weights=languages.weights.copy(), bias=languages.bias.copy())
    bent.weights[:, 0] *= -1
    bent.bias[0] *= -1
    assert bent.predict(texts)[0] == want


def test_held_out_languages(spark):
    got = queries.op5(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == 1000
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_language_edge_cases(spark, languages):
    rows = language_id.identified(spark.createDataFrame(HARD, SCHEMA), languages).collect()
    assert len(rows) == len(HARD)
    for r in rows:
        text = dict(HARD)[r.doc_id]
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        assert 0 <= r.score <= 1
    nothing = spark.createDataFrame([], "doc_id long, label string")
    docs = spark.createDataFrame(HARD, SCHEMA)
    assert {r.lang_pred for r in language_id.identified(docs, language_id.fit(docs, nothing)).collect()} == {"und"}
    one = language_id.fit(docs, spark.createDataFrame([(4, "en"), (1, "de"), (7, None)], "doc_id long, label string"))
    assert {r.lang_pred for r in language_id.identified(docs, one).collect()} == {"en", "und"}
    assert language_id.identified(docs.where("false"), languages).count() == 0


def test_samples_are_bounded_and_the_same_again(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2900, "big").otherwise("small").alias("label"))
    a = language_id.sample(docs, labels, 150)
    b = language_id.sample(docs.repartition(7), labels.repartition(5), 150)
    assert a == b and sum(x == "big" for _, x in a) == 150 and sum(x == "small" for _, x in a) == 100


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op7(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").join(docs, "doc_id").where("held_out").toPandas()
    assert (got.predicted == (got.score >= 0.3)).all()
    true = (got.predicted == 1) & (got.toxic == 1)
    assert true.sum() / got.toxic.sum() > 0.85 and true.sum() / got.predicted.sum() > 0.9
    for lang in ("en", "de", "fr", "es"):
        own = got.lang == lang
        assert true[own].sum() / got.toxic[own].sum() >= 0.8


def test_gradients_equal_differences():
    """Each gradient against the loss at two nearby values, in double precision; pooling and windows are plain loops."""
    import dataclasses

    import numpy as np

    rng = np.random.default_rng(4)
    start = toxicity._started(rng)
    model = dataclasses.replace(start, embed=start.embed.astype(np.float64), filters=[f.astype(np.float64) for f in start.filters], bias=[rng.normal(0, 0.1, toxicity.FILTERS) for _ in toxicity.WIDTHS], out=start.out.astype(np.float64))
    sizes = [1, 2, 7, 12]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    ids, y = rng.integers(0, 5, (bounds[-1], 3)), np.array([0, 1, 1, 0], np.float32)

    def loss():
        total = 0
        for r in range(len(y)):
            own = ids[bounds[r] : bounds[r + 1]]
            e = [sum(model.embed[k][w[k]] for k in range(3)) for w in own]
            act = [max(0, max(sum(e[p + j] @ model.filters[w][j][:, f] for j in range(width) if p + j < len(e)) for p in range(len(e))) + model.bias[w][f]) for w, width in enumerate(toxicity.WIDTHS) for f in range(toxicity.FILTERS)]
            z = np.dot(act, model.out) + model.out_bias
            total += np.logaddexp(0, z) - y[r] * z
        return total / len(y)

    score, by_filter, by_bias, by_out, by_out_bias, by_embed = toxicity.gradients(model, ids, bounds, y)
    assert score.shape == (4,)

    def check(array, at, want):
        was, h = array[at], 1e-5
        array[at] = was + h
        up = loss()
        array[at] = was - h
        down = loss()
        array[at] = was
        assert abs((up - down) / (2 * h) - want) < 1e-4

    for _ in range(6):
        w = int(rng.integers(3))
        at = tuple(int(rng.integers(n)) for n in model.filters[w].shape)
        check(model.filters[w], at, by_filter[w][at])
        f = int(rng.integers(toxicity.FILTERS))
        check(model.bias[w], f, by_bias[w][f])
        check(model.out, f, by_out[f])
        k = int(rng.integers(3))
        seen, grad = by_embed[k]
        i, d = int(rng.integers(len(seen))), int(rng.integers(toxicity.DIM))
        check(model.embed[k], (seen[i], d), grad[i, d])


def test_the_mean_of_networks_is_one_model():
    import numpy as np

    rng = np.random.default_rng(3)
    models = [toxicity._started(rng) for _ in range(3)]
    one = toxicity.merged(models)
    column = pa.array(["some words of a text", "x", "", "more words here"])
    want = np.mean([m.logits(column, m.tables()) for m in models], 0)
    assert np.allclose(one.logits(column, one.tables()), want, atol=1e-4)


def test_pooling_equals_a_plain_loop():
    import numpy as np

    rng = np.random.default_rng(1)
    model = toxicity.train([b"good words here", b"bad bad words", b"", b"bad"] * 6, [0, 1, 0, 1] * 6, rounds=2, members=1)
    texts = [" ".join(rng.choice(["good", "bad", "words", "longerword"], rng.integers(0, 9))) for _ in range(20)]
    buckets, first = toxicity.hashed(pa.array(texts))
    got = model.pooled(buckets, first, model.tables())
    for i in range(len(texts)):
        ids = buckets[first[i] : first[i + 1]]
        if not len(ids):
            assert not got[i].any()
            continue
        e = sum(model.embed[k][ids[:, k]] for k in range(ids.shape[1]))
        e = np.concatenate([e, np.zeros((2, toxicity.DIM))])
        want = [max(0, max(sum(e[p + j] @ model.filters[w][j][:, f] for j in range(width)) for p in range(len(ids))) + model.bias[w][f]) for w, width in enumerate(toxicity.WIDTHS) for f in range(toxicity.FILTERS)]
        assert np.allclose(got[i], want, atol=1e-4)


def test_toxicity_edge_cases(spark):
    model = toxicity.train([b"nice day", b"you idiot", b"fine", b"what an idiot"] * 20, [0, 1, 0, 1] * 20, rounds=6)
    rows = toxicity.scored(spark.createDataFrame(HARD, SCHEMA), model).collect()
    assert len(rows) == len(HARD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    blank = toxicity.train([b"a"], [0])
    assert {r.score for r in toxicity.scored(spark.createDataFrame(HARD, SCHEMA), blank).collect()} == {0.0}
    assert toxicity.scored(spark.createDataFrame([], SCHEMA), model).count() == 0
    docs = spark.createDataFrame([(1, "idiot", 0.5), (2, "nice", None), (3, None, 1.0)], SCHEMA + ", score double").withColumn("_text", F.lit(1)).withColumn("_row", F.lit(2)).withColumn("a.b", F.lit(3))
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {(r.doc_id, r["a.b"], r._row) for r in kept.collect()} == {(2, 3, 2), (3, 3, 2)}


def _toxic_rows(spark):
    """3100 toxic rows, of which the 100 with the largest hashes have a word of their own, and 400 others."""
    last = {r.id for r in spark.range(3100).orderBy(F.xxhash64(F.lit(5), "id").desc()).limit(100).collect()}
    rows = [(i, f"some {'zyzzy' if i in last else 'alpha'} text {i % 7}", 1) for i in range(3100)]
    return spark.createDataFrame(rows + [(i, f"some {('plain', 'kind', 'other')[i % 3]} text {i % 7}", 0) for i in range(4000, 4400)], SCHEMA + ", label int")


@pytest.mark.parametrize("more", [{}, {"each": 1 << 14}])
def test_toxicity_learns_from_every_labelled_row(spark, more):
    rows = _toxic_rows(spark)
    model = toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "label"), **more)
    score = model.score(pa.array(["some alpha text 1", "some zyzzy text 2", "some plain text 3", None]), model.tables())
    assert (score >= toxicity.CUT).tolist() == [True, True, False, False]


def test_toxicity_learns_from_long_texts(spark):
    calm = "peaceful mornings "
    rows = spark.createDataFrame([(i, calm * 1200 + "vile " * (i % 2) + f"day {i % 9}" if i % 4 else calm * 3 + f"day {i % 9}", i % 2) for i in range(400)], SCHEMA + ", label int")
    model = toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "label"))
    assert not model.blank
    score = model.score(pa.array([calm * 1200 + "vile day 3", calm * 1200 + "day 3", calm * 3 + "day 3"]), model.tables())
    assert (score >= toxicity.CUT).tolist() == [True, False, False]


def test_languages_are_counted_over_all_rows(spark):
    """More rows of a language than any sample took, and a text longer than any."""
    rows = [(i, "der die das", "de") for i in range(900)] + [(1000, "xqxq " + "le la les " * 9000, "fr"), (1001, None, "fr"), (1002, "the", None)]
    got = toxicity.learned_languages(spark.createDataFrame(rows, SCHEMA + ", lang string"))
    assert got.names == ["de", "fr"]
    buckets, first = toxicity.hashed(pa.array(["der", "xqxq", "les la", "", "the"]))
    counts = {"de": 2700, "fr": 27001}
    share = [(0.5 + n) / (counts[lang] + 0.5 * toxicity.BUCKETS) for lang, n in (("de", 900), ("fr", 1))]
    assert abs(got.table[0, buckets[0, -1]] - math.log(share[0])) < 1e-4 and abs(got.table[1, buckets[1, -1]] - math.log(share[1])) < 1e-4
    assert got.spoken(buckets, first).tolist()[:4] == ["de", "fr", "fr", "und"]


def test_a_spell_is_the_mean_over_chunks(spark):
    """Against a plain mean of what the learners become on each chunk; labels of null, other labels and unknown ids add nothing."""
    import numpy as np

    docs = spark.createDataFrame([(i, f"w{i % 5} word{i % 11} x" if i % 13 else "", i % 3) for i in range(200)], SCHEMA + ", more long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(150, None), (151, 2), (9999, 1), (None, 1)], "doc_id long, label int")
    chunks = toxicity._packed(docs, labels, 500)
    pieces = sorted(chunks.collect(), key=lambda r: r.chunk)
    assert len({r.chunk for r in pieces}) == len(pieces) > 2
    held = [(r.chunk, *toxicity._unpacked([tuple(r)[1:]])) for r in pieces]
    assert sum(len(y) for *_, y, _ in held) == 150 and sum(y.sum() for *_, y, _ in held) == 75
    base = [toxicity.Learner(toxicity._started(np.random.default_rng(i))) for i in range(toxicity.MEMBERS)]
    got = toxicity._turned(chunks, base, range(1, 4), 1)
    for i in range(toxicity.MEMBERS):
        moved = []
        for chunk, buckets, first, y, part in held:
            learn = np.flatnonzero((part != i) & (np.diff(first) > 0))
            now = base[i].copy()
            now.turn(buckets, first, y, learn, range(1, 4), np.random.default_rng([1, i, chunk, 1]))
            moved.append((len(learn), now))
        total = sum(n for n, _ in moved)
        assert np.allclose(got[i].dense(), sum(n * m.dense() for n, m in moved) / total, atol=1e-4)
        for k in range(3):
            for b in np.flatnonzero((got[i].past[k] != 0).any(1))[:20]:
                own = [(n, m) for n, m in moved if m.past[k, b].any()]
                assert np.allclose(got[i].model.embed[k, b], sum(n * m.model.embed[k, b] for n, m in own) / sum(n for n, _ in own), atol=1e-4)
        still = ~np.any([m.past.any(2) for _, m in moved], 0)
        assert (got[i].model.embed[still] == base[i].model.embed[still]).all()


def test_the_driver_gets_the_moves_of_one_network_at_a_time(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"word{i % 5} " + "bad" * (i % 2), i % 2) for i in range(24)], "doc_id long, text string, label int")
    kind, seen = type(rows), []
    plain = kind.collect

    def spied(df):
        got = plain(df)
        if "moved" in df.columns:
            seen.append({r.member for r in got})
        return got

    monkeypatch.setattr(kind, "collect", spied)
    model = toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "label"))
    assert not model.blank and seen and max(map(len, seen)) == 1

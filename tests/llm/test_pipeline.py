"""The pipeline against plain Python over what each stage was given, and the registered queries against their SQL."""

import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cairnlake.llm import mixing, queries
from cairnlake.llm.common import written

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.orderBy("doc_id").toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        out.append(docs.toPandas())
    return out


def test_toxic_documents_go(stages, spark):
    model = queries.toxicity_model(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    import pyarrow as pa

    score = model.score(pa.array(stages[0].text), model.tables())
    assert set(stages[1].doc_id) == set(stages[0].doc_id[score < 0.3])
    assert list(stages[1].columns) == list(stages[0].columns)


def test_one_document_of_each_group_stays(stages):
    def sh(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    docs = sorted(zip(stages[1].doc_id, map(sh, stages[1].text)))
    root = {d: d for d, _ in docs}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, (a, x) in enumerate(docs):
        for b, y in docs[i + 1 :]:
            if x and y and 100 * len(x & y) >= corpus_pipeline.NEAR_PERCENT * len(x | y):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    assert set(stages[2].doc_id) == {d for d in root if find(d) == d}


def test_contaminated_documents_go(stages):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    grams = set()
    for t in pd.read_parquet(f"{SF}/benchmark.parquet").text:
        w = words(t)
        n = min(10, len(w))
        grams |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    hit = lambda t: any(tuple(w[i : i + n]) in grams for w in [words(t)] for n in {len(g) for g in grams} for i in range(len(w) - n + 1))
    assert set(stages[3].doc_id) == {d for d, t in zip(stages[2].doc_id, stages[2].text) if not hit(t)}


def test_sources_interleave_and_files_hold_that_order(stages, spark):
    assert sorted(stages[4].doc_id) == sorted(stages[3].doc_id) and list(stages[4].columns) == list(stages[3].columns)
    want = mixing.mixed(spark.createDataFrame(stages[3])).orderBy("position").toPandas().doc_id.tolist()
    last = stages[5].sort_values("start")
    assert last.doc_id.tolist() == want
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text, start = dict(zip(stages[4].doc_id, stages[4].text)), 0
    for r in last.itertuples():
        ids = [*t.encode(text[r.doc_id] or "", add_special_tokens=False).ids, corpus_pipeline.END_ID]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_run_equals_its_stages(stages, spark):
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(map(tuple, got.values)) == sorted(map(tuple, stages[5].values))


def test_stages_bear_odd_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "y"), (2, "", "en", "s", 0, "y"), (None, "no id", "de", "s", 5, None), (9, "w " * 5000, None, "t", 10_000, "z")], "doc_id long, text string, lang string, source string, n_chars long, label string")
    clash = ("_gone", "_gone_h", "_row", "_doc", "_text", "_position", "_file", "_id", "_h", "_found", "node", "slot")
    docs = docs.selectExpr("*", *[f"{i} as {c}" for i, c in enumerate(clash)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None), (None, "nothing that stands anywhere"), (1, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 5
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, kept, str(tmp_path)))
        assert kept.columns == docs.columns and kept.where("_gone = 0 and _h = 8").count() == kept.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, written(docs.where("false")), str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cell = lambda x: None if pd.isna(x) else int(x) if isinstance(x, float) and x == int(x) else f"{x:.9g}" if isinstance(x, float) else x
    plain = lambda df: sorted(tuple(str(cell(x)) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)

"""Queries against their SQL on documents of which every third is empty."""

import os

import duckdb
import pytest
from test_catalog import SF, TABLES, plain

from cairnlake.plans import catalog


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    for t in TABLES:
        if t == "documents":
            con.sql(f"copy (select * replace (case when doc_id % 3 = 0 then '' else text end as text) from '{SF}/{t}.parquet') to '{at}/{t}.parquet' (format parquet)")
        else:
            os.symlink(f"{SF}/{t}.parquet", at / f"{t}.parquet")
        con.sql(f"create view {t} as select * from '{at}/{t}.parquet'")
    return str(at), con


def same(spark, odd, name):
    at, con = odd
    assert plain(catalog.QUERIES[name](spark, at).toPandas()) == plain(con.sql(catalog.ORACLE[name]).df())


def test_ls_of_empty_files(spark, odd):
    same(spark, odd, "ls")


def test_verify_files_without_chunks(spark, odd):
    same(spark, odd, "verify_files")


def test_verify_origin_without_chunks(spark, odd):
    same(spark, odd, "verify_origin")


@pytest.mark.parametrize("name", ["verify_report", "validate_listing"])
def test_reports_without_chunks(spark, odd, name):
    same(spark, odd, name)


def test_batches_of_long_texts_are_small(spark, tmp_path):
    from cairnlake.plans import trees

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(64 << 20))
    spark.range(24, numPartitions=1).selectExpr("id doc_id", "'s' source", "'en' lang", "repeat('x', 1 << 20) text").write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(map(len, b.column("content").to_pylist()))]})

    try:
        got = [r.n for r in trees.tree(spark, str(tmp_path)).select("content").mapInArrow(sizes, "n long").collect()]
    finally:
        spark.conf.set(key, before)
    assert sum(got) == 24 << 20 and max(got) <= 6 << 20


def test_zstd_of_empty_and_null(spark):
    from pyspark.sql import functions as F

    from cairnlake.functions import codecs

    at = spark.createDataFrame([(b"",), (None,), (b"abc" * 999,)], "x binary").select("x", codecs.encoded(F.col("x"), "zstd").alias("p"))
    assert [(r.x, r.y) for r in at.select("x", codecs.decoded(F.col("p"), "zstd").alias("y")).collect()] == [(b"", b""), (None, None), (b"abc" * 999, b"abc" * 999)]


def _pieces_made(spark):
    from cairnlake.plans import catalog as c

    made = c._entries(spark, SF).drop("doc_id")
    return made, c.listing_files.encode_dir(made)


def test_cfdir_in_pieces_has_the_same_bytes(spark, monkeypatch):
    from cairnlake.sources import listing_files

    monkeypatch.setattr(listing_files, "PIECE", 999)
    made, data = _pieces_made(spark)
    pieces = listing_files.encode_pieces(made)
    assert b"".join(bytes(r.data) for r in pieces.orderBy("ord").collect()) == data
    assert sorted(map(str, listing_files.decode_pieces(pieces).collect())) == sorted(map(str, listing_files.decode_dir_frame(spark, data).collect()))
    none = listing_files.encode_pieces(made.where("false"))
    assert listing_files.decode_pieces(none).count() == 0
    with pytest.raises(Exception, match="duplicate path"):
        listing_files.encode_pieces(made.unionByName(made.limit(1)))


def test_cfdir_in_pieces_is_checked(spark):
    from cairnlake.sources import listing_files
    from cairnlake.sources.listing_files import _sealed

    _, data = _pieces_made(spark)

    def read(b, step=777):
        rows = [(k, b[k : k + step]) for k in range(0, len(b), step)]
        return listing_files.decode_pieces(spark.createDataFrame(rows, "ord long, data binary"))

    assert read(data).count() == len(list(listing_files.decode_dir(data)))
    body, head = data[:-32], listing_files._DIR_HEAD.size
    n = listing_files._entry_end(body, head, len(body))
    one = bytes(body[:16]) + (1).to_bytes(8, "little") + body[head:n]
    for fault, bad in (
        ("trailer checksum", body + bytes(32)), ("left over", _sealed(one + b"x")), ("of 2 entries", _sealed(one[:16] + (2).to_bytes(8, "little") + one[24:])),
        ("duplicate path", _sealed(one[:16] + (2).to_bytes(8, "little") + one[24:] + one[24:])), ("not a cfdir|BadMagic", b"nonsense" * 99),
    ):
        with pytest.raises(Exception, match=fault):
            read(bad)


def test_codec_roundtrip_sends_no_entries_to_the_driver(spark, odd, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *a, **k: pytest.fail("rows come to the driver"))
    same(spark, odd, "codec_roundtrip")


def test_indexes_are_hashed_together(monkeypatch):
    from cairnlake.functions import blake3
    from cairnlake.schema import TrailerMismatch
    from cairnlake.sources import listing_files as lf

    blobs = [(n, "ab" * 32, [(e, f"{e:064x}") for e in [*range(10, n, 10), *([n] if n else [])]]) for n in [*range(500), 30_000]]
    one = [lf.encode_index(*b) for b in blobs]
    calls, plain_ = [], blake3.digests
    monkeypatch.setattr(blake3, "digests", lambda x: calls.append(len(x)) or plain_(x))
    assert lf.encode_indexes(blobs) == one
    assert [(g["size"], g["blob_id"], g["chunks"]) for g in lf.decode_indexes(one)] == blobs
    assert len(calls) < 12
    with pytest.raises(TrailerMismatch):
        lf.decode_indexes([*one[:7], one[7][:-1] + bytes([one[7][-1] ^ 1]), *one[8:]])
    assert lf.encode_indexes([]) == lf.decode_indexes([]) == []


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_payloads_are_moved_once(spark, tmp_path, monkeypatch):
    from cairnlake.operators import chunking, store
    from cairnlake.plans import trees

    plans, write = [], store.Store._write
    monkeypatch.setattr(store.Store, "_write", lambda self, rows, *a, **k: plans.append(_exchanges(rows)) or write(self, rows, *a, **k))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = store.Store.create(spark, f"file://{tmp_path}/s")
        first = s.put(chunking.blob_payloads(trees.v1(spark, SF), trees.CHUNK))
        again = s.put(chunking.blob_payloads(trees.v1(spark, SF), trees.CHUNK))
        assert again["written"] == 0 and again["skipped"] == first["written"] + first["skipped"]
        monkeypatch.setattr(store, "MOST", 3)  # more are new than are broadcast
        second = s.put(chunking.blob_payloads(trees.v2(spark, SF), trees.CHUNK))
        ids = {r.chunk_id for r in s.ids().collect()}
        assert s.ids().count() == len(ids) == first["written"] + second["written"]
        gone = s.list().where("chunk_id like '%0'")
        n = gone.count()
        assert s.remove(gone) == n and {r.chunk_id for r in s.ids().collect()} == {i for i in ids if i[-1] != "0"}
        assert {r.status for r in s.scrub().collect()} == {"ok"}
        assert s.compact() == len(ids) - n and s.compact() == len(ids) - n
        assert set(s.chunks().columns) == {"chunk_id", "prefix", "payload"} and {r.status for r in s.scrub().collect()} == {"ok"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # put, put, put and remove move ids for the part that is not to be written as often as they like, payloads once
    assert plans[0] == 1 and plans[1] == 1 and plans[2] == 1 and plans[-1] == 1, plans
    assert len(plans) == 5  # the last compaction has nothing to do

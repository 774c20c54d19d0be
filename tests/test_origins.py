"""Origins: fallbacks, caches, HTTP push and pull with verification, deep doctor, flag checks."""

import http.server
import random
import threading

import pytest
from pyspark.sql import functions as F

from cairnlake.functions import blake3
from cairnlake.functions.hashing import hash_streams
from cairnlake.functions.pathfilter import PathFilter
from cairnlake.operators import chunking, ingest, origin, seed, store
from cairnlake.schema import BLOBS, CairnError, ChunkCorrupt, IdMismatch
from cairnlake.sources import http as remote
from cairnlake.sources.retry import RetryPolicy

FIXED = 8
TREE = {"a/one.txt": b"0123456789abcdef0123", "a/two.txt": b"89abcdef", "b/three": b"zzzzzzzzzzzz", "b/empty": b""}


def blobs(spark, tree):
    return spark.createDataFrame([(p, "file", 420, len(c), 1, None, c) for p, c in tree.items()], BLOBS)


def listed(spark, tree=TREE):
    return chunking.with_chunks(blobs(spark, tree), FIXED)


def made(spark, path, tree=TREE):
    s = store.Store.create(spark, f"file://{path}")
    s.put(chunking.blob_payloads(blobs(spark, tree), FIXED))
    return s


class Stub(http.server.BaseHTTPRequestHandler):
    held: dict = {}
    failing: set = set()

    def _say(self, code, body=b""):
        self.send_response(code)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(body)

    def do_GET(self):
        if self.path in self.failing:
            return self._say(503)
        self._say(200 if self.path in self.held else 404, self.held.get(self.path, b""))

    do_HEAD = do_GET

    def do_PUT(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        if self.path in self.failing:
            return self._say(503)
        self.held[self.path] = body
        self._say(201)

    def log_message(self, *a):
        pass


@pytest.fixture
def server():
    Stub.held, Stub.failing = {}, set()
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield remote.Endpoint(f"http://127.0.0.1:{s.server_port}", policy=RetryPolicy(1, 0.001, 0.002))
    s.shutdown()


def url(chunk_id):
    return f"/chunks/{chunk_id[:2]}/{chunk_id[2:]}.cnk"


def test_push_and_pull_over_http(spark, tmp_path, server):
    local, listing = made(spark, tmp_path / "local"), listed(spark)
    n = local.list().count()
    dry = ingest.push([listing], local, server, dry_run=True, verify=True)
    assert (dry["uploaded"], dry["verified"], len(Stub.held)) == (n, None, 0)
    report = ingest.push([listing], local, server, verify=True)
    assert (report["uploaded"], report["skipped"], report["failed"], report["verified"], len(Stub.held)) == (n, 0, 0, 1, n)
    assert ingest.push([listing], local, server)["skipped"] == n
    empty = store.Store.create(spark, f"file://{tmp_path}/empty")
    some = ingest.pull([listing], empty, server, PathFilter(("a",), ()))
    assert 0 < some["fetched"] < n and some["ok"]
    # the scope shrinks what is moved, not what is verified
    with pytest.raises(ChunkCorrupt, match="missing chunk"):
        ingest.pull([listing], empty, server, PathFilter(("a",), ()), verify=True)
    rest = ingest.pull([listing], empty, server, verify=True)
    assert rest["fetched"] + some["fetched"] == n and rest["skipped"] == some["fetched"] and rest["verified"] == 1
    assert ingest.pull([listing], empty, server, dry_run=True)["skipped"] == n


def test_failures_are_counted_and_nothing_is_verified(spark, tmp_path, server):
    local, listing = made(spark, tmp_path / "local"), listed(spark)
    ids = sorted(r.chunk_id for r in local.list().collect())
    Stub.failing = {url(ids[0])}
    report = ingest.push([listing], local, server, verify=True)
    assert (report["failed_transient"], report["uploaded"], report["ok"], report["verified"]) == (1, len(ids) - 1, False, None)
    local.remove(spark.createDataFrame([(ids[1],)], "chunk_id string"))
    report = ingest.push([listing], local, server)
    assert report["failed_permanent"] == 1  # not local, though the endpoint has it
    other = store.Store.create(spark, f"file://{tmp_path}/other")
    del Stub.held[url(ids[2])]
    Stub.held[url(ids[1])] = b"changed"
    report = ingest.pull([listing], other, server)
    assert (report["failed_transient"], report["failed_permanent"], report["fetched"]) == (1, 2, len(ids) - 3)
    with pytest.raises(CairnError, match=ids[0]):
        origin.doctor([listing], origin.HttpOrigin(server), deep=True)


def test_fallback_and_cache(spark, tmp_path, server):
    whole = made(spark, tmp_path / "whole")
    ids = sorted(r.chunk_id for r in whole.list().collect())
    part = store.Store.create(spark, f"file://{tmp_path}/part")
    part.put(whole.chunks().where(F.col("chunk_id").isin(ids[:2])).select("chunk_id", "payload"))
    remote.upload(whole.chunks().where(F.col("chunk_id").isin(ids[2:-1])).select("chunk_id", "payload"), server).collect()
    chain = origin.Fallback((origin.open_origin(spark, f"file://{tmp_path}/part"), origin.open_origin(spark, server.base, policy=server.policy)))
    asked = spark.createDataFrame([(i, c) for i, c in enumerate([*ids, ids[0]])], "ord long, chunk_id string")
    got = {r.chunk_id: r.outcome for r in chain.read(asked).collect()}
    assert got == {c: "missing" if c == ids[-1] else "fetched" for c in ids}
    assert {r.chunk_id for r in chain.has(asked).collect()} == set(ids[:-1])
    Stub.failing = {url(ids[2])}  # a failure doesn't move on
    both = origin.Fallback((origin.HttpOrigin(server), origin.StoreOrigin(whole)))
    assert {r.chunk_id: r.outcome for r in both.read(asked).collect()}[ids[2]] == "failed_transient"
    Stub.failing = set()
    cache = store.Store.create(spark, f"file://{tmp_path}/cache")
    reads, report = origin.cached_read(chain, cache, asked, budget=16)
    assert sorted(r.outcome for r in reads.collect()) == ["fetched"] * (len(ids) - 1) + ["missing"]
    r = report.first()
    assert r.cache_miss_fills == cache.list().count() > 0 and r.cache_hits >= 1
    assert cache.stats().first().bytes_plaintext <= 16
    again, _ = origin.cached_read(chain, cache, asked, budget=16)
    assert [x.outcome for x in again.collect()].count("hit") == r.cache_miss_fills
    with pytest.raises(ValueError):
        origin.Fallback(())


def test_doctor_and_summary(spark, tmp_path, server):
    whole, listing = made(spark, tmp_path / "whole"), listed(spark)
    at = origin.StoreOrigin(whole)
    ids = sorted(r.chunk_id for r in whole.list().collect())
    for deep in (False, True):
        r = origin.doctor([listing, listing], at, deep).first()
        assert (r.listings, r.missing, r.deep, r.ok) == (2, 0, deep, True) and r.checked == 2 * sum(len(x.chunks or ()) for x in listing.collect())
    whole.remove(spark.createDataFrame([(ids[0],)], "chunk_id string"))
    assert origin.doctor([listing], at, True).first().missing == 1
    assert origin.summary(at)["compression"] == "none" and origin.summary(origin.HttpOrigin(server))["probed"]
    with pytest.raises(CairnError):
        origin.summary(origin.HttpOrigin(remote.Endpoint("http://127.0.0.1:1", timeout=0.5)))


def test_flags():
    ok = [dict(specs=["/s"]), dict(specs=["/s", "http://h"], http_options=True), dict(specs=[], dest="http://h", http_options=True), dict(specs=["/s"], cache="/c", cache_max_bytes=1), dict(specs=[], dest="/d", compression="zstd")]
    bad = [dict(specs=[]), dict(specs=["/s"], http_options=True), dict(specs=["/s"], cache_max_bytes=1), dict(specs=["/s"], jobs=0), dict(specs=[], dest="/d", http_options=True), dict(specs=[], dest="https://h", compression="zstd")]
    for x in ok:
        origin.check_flags(**x)
    for x in bad:
        with pytest.raises(ValueError):
            origin.check_flags(**x)


def test_compaction_and_many_prefixes(spark, tmp_path):
    s = store.Store.create(spark, f"file://{tmp_path}/s", "zstd")
    rng = random.Random(1)
    for k in range(3):
        rows = [(hash_streams(iter([d])), d) for d in (rng.randbytes(20) for _ in range(60))]
        assert s.put(spark.createDataFrame(rows + rows[:5], "chunk_id string, payload binary")) == {"written": 60, "skipped": 5}
    before = sorted((r.chunk_id, bytes(r.payload)) for r in s.chunks().collect())
    assert s.compact() == 180 and len(s._manifest()) == 1
    assert sorted((r.chunk_id, bytes(r.payload)) for r in s.chunks().collect()) == before


def test_put_moves_new_payloads_only(spark, tmp_path):
    s = made(spark, tmp_path / "s")
    more = TREE | {"b/new": b"new bytes"}
    assert s.put(chunking.blob_payloads(blobs(spark, TREE), FIXED))["written"] == 0
    assert s.put(chunking.blob_payloads(blobs(spark, more), FIXED))["written"] == 2
    with pytest.raises(IdMismatch):
        s.put(spark.createDataFrame([("0" * 64, b"x")], "chunk_id string, payload binary"))


def test_seeds_below_symlinks_are_refused(spark):
    tree = blobs(spark, {"link/f": b"01234567", "plain/f": b"01234567"})
    plan = seed.seed_plan(chunking.with_chunks(tree, FIXED))
    linked = tree.unionByName(spark.createDataFrame([("link", "symlink", 511, None, None, "plain", None)], BLOBS))
    assert [r.path for r in seed.seed_reads(plan, tree).collect()] == ["link/f"]
    assert [r.path for r in seed.seed_reads(plan, linked).collect()] == ["plain/f"]


def test_blake3_in_pieces():
    rng = random.Random(1)
    for n in (0, 1, 1024, 1025, 1 << 20, (1 << 20) + 1, (3 << 20) + 17):
        d, h, at = rng.randbytes(n), blake3.Hasher(), 0
        while at < n:
            k = rng.randrange(1, 700_000)
            h.update(d[at : at + k])
            at += k
        assert h.hexdigest() == blake3.digest(d).hex()

"""Listings, differences, stores, reading back, seeds, transfers, sources and streaming on small trees."""

import http.server
import os
import struct
import threading

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cairnlake.functions.pathfilter import PathFilter
from cairnlake.operators import chunking, diff, ingest, listing, readpath, seed, store, transfer
from cairnlake.schema import BLOBS, ENTRIES, BadMagic, CairnError, ChunkCorrupt, ChunkNotFound, ChunkParams, IdMismatch, InvalidPath, InvalidStructure, StoreError, TrailerMismatch, Truncated, UnsupportedFormatVersion, UnsupportedMajor
from cairnlake.sources import http as remote
from cairnlake.sources import listing_files, local_tree
from cairnlake.sources.retry import RetryPolicy
from cairnlake.streaming import incremental

FIXED = 4


def blobs(spark, files, mode=0o644):
    rows = [(p, "file", mode, len(b), 100, None, b) for p, b in files.items()]
    return spark.createDataFrame(rows, BLOBS)


def listed(spark, files, links=None, dirs=(), **how):
    made = chunking.with_chunks(blobs(spark, files, **how), FIXED)
    extra = [(p, "symlink", 0o777, None, None, None, t, None) for p, t in (links or {}).items()] + [(d, "dir", 0o755, None, None, None, None, None) for d in dirs]
    return made.select(*ENTRIES.names).unionByName(spark.createDataFrame(extra, ENTRIES)) if extra else made.select(*ENTRIES.names)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


TREE = {"a.txt": b"12345678", "sub/b.txt": b"1234abcdX", "a-copy.txt": b"12345678", "empty": b"", "pkg/foo/ü": "grüße".encode(), "pkg/foo2": b"same-same"}


def test_chunks_of_small_files(spark):
    entries = listed(spark, TREE)
    refs = chunking.chunk_refs(entries)
    assert rows(refs.where("path = 'sub/b.txt'"), "ord", "start_offset", "end_offset", "length") == [(0, 0, 4, 4), (1, 4, 8, 4), (2, 8, 9, 1)]
    assert refs.where("path = 'empty'").count() == 0
    assert entries.where("path = 'empty'").select(F.size("chunks").alias("n")).first().n == 0
    c = chunking.dedup_counters(refs).first()
    total = refs.count()
    distinct = refs.select("chunk_id").distinct().count()
    assert (c.chunks, c.new, c.reused) == (total, distinct, total - distinct)
    assert chunking.breaks(refs).count() == 0
    none = chunking.dedup_counters(refs.where("false")).first()
    assert (none.chunks, none.new, none.bytes) == (0, 0, 0)


def test_fixed_and_cdc_agree_with_their_payloads(spark):
    for how in ({"size": FIXED}, {"params": ChunkParams(2, 64, 128)}, {"size": FIXED, "algorithm": "blake3"}):
        b = blobs(spark, {**TREE, "long": bytes(range(256)) * 8})
        made = chunking.with_chunks(b, how.get("size"), how.get("params"), how.get("algorithm", "sha256"))
        pieces = chunking.blob_payloads(b, how.get("size"), how.get("params"), how.get("algorithm", "sha256")).groupBy("chunk_id").agg(F.first("payload").alias("payload"))
        report = readpath.verify_report(readpath.verify(made, pieces, how.get("algorithm", "sha256"))).first()
        assert report.ok and report.files == 7


def test_registered_functions(spark):
    chunking.register(spark)
    n = spark.sql("select * from (select encode(repeat('abcdefgh', 50), 'utf-8') c) t, lateral cdc_chunks(t.c, 2, 64, 128)").agg(F.sum("length")).first()[0]
    assert n == 400
    assert spark.sql("select blake3(encode('abc', 'utf-8')) h").first().h.startswith("6437b3ac")


def test_scopes_keep_ancestors_only(spark):
    entries = listed(spark, TREE, {"pkg/l": "foo2"}, ["pkg", "pkg/foo", "sub", "void"])
    got = lambda f: {r.path for r in listing.filtered(entries, f).collect()}
    assert got(PathFilter(("pkg/foo",))) == {"pkg", "pkg/foo", "pkg/foo/ü"}
    assert got(PathFilter(("void",))) == {"void"}
    assert got(PathFilter()) == {*TREE, "pkg/l", "pkg", "pkg/foo", "sub", "void"}
    assert got(PathFilter((), ("*",))) == set()
    report = listing.scope_counts(entries, PathFilter(("pkg",), ("*2",))).first()
    assert (report.files, report.dirs, report.symlinks, report.excluded) == (1, 2, 1, 5)


def test_directory_views(spark):
    entries = listed(spark, TREE, {"pkg/l": "foo2"}, ["sub"])
    assert [r.name for r in listing.readdir(entries, "pkg").collect()] == ["foo", "foo2", "l"]
    assert [(r.name, r.kind) for r in listing.readdir(entries).collect()][:2] == [("a-copy.txt", "file"), ("a.txt", "file")]
    modes = {r.path: r.mode for r in listing.tree(entries).where("kind = 'dir'").collect()}
    assert modes == {"": 0o555, "pkg": 0o555, "pkg/foo": 0o555, "sub": 0o755}
    assert listing.readlink(entries, "pkg/l").first().target == "foo2"
    assert listing.getattr_(entries, "a.txt").first().size == 8
    assert listing.statfs(entries).first().files == 6
    assert [r.path for r in listing.ls(entries).collect()] == sorted([*TREE, "pkg/l", "sub"], key=lambda p: p.encode())
    assert listing.lookup_file(entries, "./a.txt").count() == 1
    for bad in ("nope", "sub", "pkg/l", "../a"):
        with pytest.raises(InvalidPath):
            listing.lookup_file(entries, bad)
    with pytest.raises(CairnError):
        listing.refs_in_scope(entries, PathFilter(("a",)), single_blob=True)


def test_diff_categories(spark):
    left = listed(spark, {"same": b"1", "gone": b"2", "text": b"3", "mode": b"4", "kind": b"5", "isdir": b"x"}, {"ln": "a", "lm": "b"})
    right = listed(spark, {"same": b"1", "new": b"2", "text": b"9", "mode": b"4"}, {"ln": "c", "lm": "b", "kind": "same"}, ["isdir"])
    right = right.withColumn("mode", F.when(F.col("path").isin("mode", "lm"), F.col("mode") + 1).otherwise(F.col("mode")))
    assert dict(rows(diff.diff_paths(left, right))) == {"same": "same", "gone": "removed", "new": "added", "text": "changed", "mode": "meta_changed", "ln": "changed", "lm": "meta_changed", "kind": "changed", "isdir": "removed"}
    s = diff.summary(left, right).first()
    assert (s.added, s.removed, s.changed, s.meta_changed, s.same, s.differs) == (1, 2, 3, 2, 1, True)
    assert not diff.summary(left, left).first().differs
    live = left.withColumn("mtime_secs", F.lit(7).cast("long"))
    assert {c for _, c in rows(diff.diff_paths(diff.tree_as_listing(live, left), left))} == {"same"}


def test_violations(spark):
    e = [{"end_offset": 4, "chunk_id": "a"}, {"end_offset": 4, "chunk_id": "b"}]
    bad = [("up", "file", 0, 4, 0, "x", None, e), ("none", "file", 0, 4, 0, "x", None, []), ("zero", "file", 0, 0, 0, "x", None, e[:1]), ("/abs", "dir", 0, None, None, None, None, None), ("ln", "symlink", 0, None, None, None, "", None), ("two", "dir", 0, None, None, None, None, None), ("two", "dir", 0, None, None, None, None, None), (None, "dir", 0, None, None, None, None, None)]
    got = rows(listing.violations(spark.createDataFrame(bad, ENTRIES)).where("path is not null"))
    assert got == [("/abs", "path: absolute"), ("ln", "empty target"), ("none", "no chunks"), ("two", "duplicate path"), ("up", "end offsets don't increase"), ("zero", "chunks in an empty file"), ("zero", "last end differs from size")]
    assert listing.violations(listed(spark, TREE, {"l": "a"}, ["d"])).count() == 0
    assert listing.violations(listed(spark, TREE, {"l": "a"}), format_version=1).first().fault == "symlink in version 1"


@pytest.mark.parametrize("compression", ["none", "zstd"])
def test_store(spark, tmp_path, compression):
    root = f"file://{tmp_path}/store"
    s = store.Store.create(spark, root, compression)
    with pytest.raises(StoreError):
        store.Store.create(spark, root)
    with pytest.raises(StoreError):
        store.Store.open(spark, f"file://{tmp_path}/nothing")
    assert store.Store.open(spark, root).compression == compression
    with pytest.raises(StoreError):
        store.Store.open_or_create(spark, root, "none" if compression == "zstd" else "zstd")
    b = blobs(spark, TREE)
    entries = listed(spark, TREE)
    ids = {r.chunk_id for r in chunking.chunk_refs(entries).collect()}
    total = chunking.chunk_refs(entries).count()
    assert s.list().count() == 0 and s.stats().first().bytes_on_disk == 0
    assert s.put(chunking.blob_payloads(b, FIXED)) == {"written": len(ids), "skipped": total - len(ids)}
    assert s.put(chunking.blob_payloads(b, FIXED)) == {"written": 0, "skipped": total}
    assert [r.chunk_id for r in s.list().collect()] == sorted(ids)
    one = min(ids)
    assert s.has(one) and not s.has("0" * 64)
    assert len(s.get(one, verify=True)) <= FIXED
    with pytest.raises(ChunkNotFound):
        s.get("0" * 64)
    with pytest.raises(IdMismatch):
        s.put(spark.createDataFrame([("0" * 64, b"x")], "chunk_id string, payload binary"))
    stats = s.stats().first()
    assert stats.chunks == len(ids) and (stats.bytes_plaintext is None) == (compression == "zstd")
    assert s.stats(decode=True).first().bytes_plaintext == sum(len(s.get(i)) for i in ids)
    assert {r.status for r in s.scrub().collect()} == {"ok"}
    lost = spark.createDataFrame([("f" * 64,)], "chunk_id string")
    assert rows(s.scrub(lost)) == [("f" * 64, "unreadable")]
    keep = chunking.chunk_refs(entries.where("path = 'a.txt'"))
    kept = {r.chunk_id for r in keep.collect()}
    dry = s.gc([keep])
    assert dry["unreferenced"] == len(ids - kept) and dry["deleted"] == 0 and s.list().count() == len(ids)
    assert s.gc([keep], apply=True)["deleted"] == len(ids - kept)
    assert {r.chunk_id for r in s.list().collect()} == kept
    assert store.doctor([chunking.chunk_refs(entries)], s.ids()).first().asDict() == {"listings": 1, "checked": total, "missing": len(ids - kept), "ok": False}
    assert s.remove(s.ids()) == len(kept) and s.list().count() == 0


def test_corrupt_chunks(spark, tmp_path):
    s = store.Store.create(spark, f"file://{tmp_path}/s", "none")
    wrong = "0" * 64
    s.put(spark.createDataFrame([(wrong, b"x")], "chunk_id string, payload binary"), verify=False)
    assert s.get(wrong) == b"x"
    with pytest.raises(ChunkCorrupt):
        s.get(wrong, verify=True)
    assert rows(s.scrub()) == [(wrong, "corrupt")]
    r = store.scrub_report(s.scrub()).first()
    assert (r.checked, r.corrupt, r.ok) == (1, 1, False)


@pytest.mark.parametrize("bad", ["", 'magic = "X"\nversion = 1\ncompression = "none"', 'magic = "CFSTORE"\nversion = 2\ncompression = "none"', 'magic = "CFSTORE"\nversion = 1\ncompression = "ZSTD"', "=="])
def test_bad_meta(bad):
    with pytest.raises(StoreError):
        store.parse_meta(bad)
    assert store.parse_meta(store.meta_text("zstd") + "other = 1\n") == "zstd"


def test_reading_back(spark):
    b = blobs(spark, TREE)
    entries = listed(spark, TREE, {"l": "a", "abs": "/x"})
    stored = chunking.blob_payloads(b, FIXED).distinct()
    for path, data in TREE.items():
        assert readpath.cat_bytes(entries, stored, path) == data
    faults = {r.path: r.fault for r in readpath.verify(entries, stored).collect()}
    assert {p: f for p, f in faults.items() if f} == {"abs": "absolute target"}
    holes = stored.where(F.col("payload") != b"1234")
    faults = {r.path: r.fault for r in readpath.verify(entries, holes).collect() if r.fault}
    assert faults == {"a.txt": "0: missing chunk", "a-copy.txt": "0: missing chunk", "sub/b.txt": "0: missing chunk", "abs": "absolute target"}
    with pytest.raises(CairnError):
        readpath.cat_bytes(entries, holes, "a.txt")
    bent = stored.withColumn("payload", F.when(F.col("payload") == b"X", F.lit(b"Y")).otherwise(F.col("payload")))
    report = readpath.verify_report(readpath.verify(entries.where("kind = 'file'"), bent)).first()
    assert (report.faults, report.first_fault) == (1, "sub/b.txt: 2: corrupt chunk")
    for off, n in ((0, 3), (2, 5), (3, 100), (8, 1), (50, 4)):
        got = readpath.read_range(entries.where("path = 'sub/b.txt'"), stored, off, n).orderBy("start_offset").collect()
        assert b"".join(bytes(r.payload) for r in got) == TREE["sub/b.txt"][off : off + n]


def test_extract_rules(spark):
    entries = listed(spark, {"new": b"1", "same": b"22", "other": b"33", "isdir": b"4"}, {"l": "a", "abs": "/x", "lf": "a", "ls": "a"}, ["d", "df"])
    there = listed(spark, {"same": b"22", "other": b"3x", "lf": b"", "df": b""}, {"l": "b", "ls": "a"}, ["isdir", "d"]).select("path", "kind", "size", "mtime_secs", "blob_id", "target")
    plan = lambda **k: {r.path: r.action for r in readpath.extract_plan(entries, there, **k).collect()}
    always = {"new": "write", "isdir": "fail", "abs": "fail", "lf": "fail", "d": "write", "df": "fail"}
    assert plan() == always | {"same": "fail", "other": "fail", "l": "fail", "ls": "fail"}
    assert plan(force=True) == always | {"same": "write", "other": "write", "l": "write", "ls": "write"}
    assert plan(skip_unchanged=True) == always | {"same": "skip", "other": "fail", "l": "fail", "ls": "skip"}
    assert plan(force=True, skip_unchanged=True) == always | {"same": "skip", "other": "write", "l": "write", "ls": "skip"}
    assert plan(skip_unchanged=True, trust_mtime=True)["other"] == "skip"
    r = readpath.plan_report(readpath.extract_plan(entries, there, force=True, skip_unchanged=True)).first()
    assert (r.would_skip, r.would_write, r.would_dirs, r.would_fail, r.would_symlinks) == (2, 3, 1, 4, 1)
    verdicts = {r.path: r.verdict for r in readpath.unchanged_verdict(entries, there).collect()}
    assert verdicts == {"new": "missing", "same": "unchanged", "other": "content_mismatch", "isdir": "type_mismatch"}


def test_archive_and_extract_a_tree(spark, tmp_path):
    root = tmp_path / "src"
    for p, data in TREE.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(data)
    (root / "void").mkdir()
    os.symlink("a.txt", root / "link")
    os.mkfifo(root / "pipe")
    os.chmod(root / "a.txt", 0o600)
    made, skipped = local_tree.walk(str(root))
    assert {r[0] for r in made} == set(TREE) and skipped == {"skipped_symlinks": 1, "skipped_special": 1}
    tree = local_tree.with_content(local_tree.inventory(spark, str(root), symlinks="record", empty_dirs=True), str(root))
    s = store.Store.create(spark, f"file://{tmp_path}/store", "zstd")
    entries, counts = ingest.archive(tree, s, fixed=FIXED)
    assert (counts["files"], counts["dirs"], counts["recorded_symlinks"], counts["excluded"]) == (6, 1, 1, 0)
    assert counts["written"] == s.list().count() and counts["written"] + counts["reused"] == counts["chunks"]
    dry = ingest.archive(tree, s, fixed=FIXED, dry_run=True)[1]
    assert dry["would_write"] == 0 and dry["would_reuse"] == counts["chunks"]
    again, counts2 = ingest.archive(tree, s, fixed=FIXED, prior=entries)
    assert counts2["seed_reused_files"] == 6 and counts2["written"] == 0 and rows(again, "path", "blob_id") == rows(entries, "path", "blob_id")
    assert ingest.archive(tree, s, PathFilter(("sub",)), fixed=FIXED)[1]["excluded"] == 7
    out = tmp_path / "out"
    readpath.extract(entries, s.chunks(), str(out)).count()
    assert {p: (out / p).read_bytes() for p in TREE} == TREE
    assert os.readlink(out / "link") == "a.txt" and (out / "void").is_dir() and (out / "a.txt").stat().st_mode & 0o777 == 0o600
    with pytest.raises(Exception, match="exists"):
        readpath.extract(entries, s.chunks(), str(out)).count()
    readpath.extract(entries, s.chunks(), str(out), force=True).count()
    with pytest.raises(ValueError):
        os.symlink("/abs", root / "bad")
        local_tree.walk(str(root), symlinks="record")


def test_make_with_and_without_seed(spark, tmp_path):
    s = store.Store.create(spark, f"file://{tmp_path}/store")
    one = blobs(spark, {"x": b"abcdabcdZ"})
    entry, c = ingest.make(one, s, fixed=FIXED)
    assert (c["bytes"], c["chunks"], c["new"], c["reused"]) == (9, 3, 2, 1)
    assert ingest.make(one, s, fixed=2, prior=entry)[1] == {"ok": True, "bytes": 9, "chunks": 3, "new": 0, "reused": 3, "seed_reused": True}
    assert ingest.make(blobs(spark, {"x": b"abcdabcdY"}), s, fixed=FIXED, prior=entry, dry_run=True)[1]["would_write"] == 1
    s.remove(s.ids())
    with pytest.raises(ChunkNotFound):
        ingest.make(one, s, fixed=FIXED, prior=entry)


def test_seeds(spark):
    prior = listed(spark, {"same": b"12345678", "size": b"1", "text": b"aaaa", "touched": b"bbbb"})
    source = listed(spark, {"same": b"12345678", "size": b"12", "text": b"aaab", "touched": b"bbbb", "new": b"c"}).withColumn("mtime_secs", F.when(F.col("path") == "touched", 5).otherwise(F.col("mtime_secs")))
    got = lambda **k: dict(rows(seed.decisions(source, prior, **k)))
    assert got() == {"same": "reuse", "size": "rechunk", "text": "rechunk", "touched": "reuse", "new": "rechunk"}
    assert got(trust_mtime=True)["text"] == "reuse"
    assert {r.path for r in seed.needs_hash(source, prior).collect()} == {"same", "text", "touched"}
    assert {r.path for r in seed.needs_hash(source, prior, trust_mtime=True).collect()} == {"touched"}
    stored = chunking.chunk_refs(prior.where("path <> 'touched'"))
    kept = {r.path: (r.decision, r.seed_missing) for r in seed.reusable(seed.decisions(source, prior), prior, stored).collect()}
    assert kept["same"] == ("reuse", False) and kept["touched"] == ("rechunk", True)
    files = {"a": b"11112222", "b": b"2222", "../x": b"3333"}
    plan = seed.seed_plan(listed(spark, files))
    assert "../x" not in {r.path for r in plan.collect()}
    live = blobs(spark, {"a": b"1111", "b": b"2222"})
    reads = seed.seed_reads(plan, live)
    assert {(r.path, r.offset, bytes(r.payload)) for r in reads.collect()} == {("a", 0, b"1111"), ("b", 0, b"2222")}
    stats = seed.seed_stats(chunking.chunk_refs(listed(spark, {**files, "z": b"zzzz"})), plan, seed.seed_reads(plan, blobs(spark, {"b": b"2222"}))).first()
    assert (stats.hits, stats.stale, stats.misses, stats.bytes) == (1, 1, 2, 4)


def test_transfers(spark, tmp_path):
    a, b = store.Store.create(spark, f"file://{tmp_path}/a"), store.Store.create(spark, f"file://{tmp_path}/b", "zstd")
    entries = listed(spark, TREE)
    a.put(chunking.blob_payloads(blobs(spark, TREE), FIXED))
    n = a.list().count()
    assert ingest.push([entries], a, b, dry_run=True)["uploaded"] == n and b.list().count() == 0
    first = ingest.push([entries], a, b, PathFilter(("a.txt",)))
    assert first["uploaded"] == 2 and first["ok"]
    assert ingest.push([entries, entries], a, b) | {} == {"skipped": 2, "uploaded": n - 2, "failed_transient": 0, "failed_permanent": 0, "unique_chunks": n, "failed": 0, "listings": 2, "dry_run": False, "ok": True}
    a.remove(a.ids())
    assert ingest.push([entries], a, b)["failed_permanent"] == n  # not local, though the remote has all
    assert ingest.pull([entries], a, b)["fetched"] == n
    assert readpath.verify_report(readpath.verify(entries, a.chunks())).first().ok


def test_fallback_and_cache(spark):
    src = lambda ids, tag: spark.createDataFrame([(i, tag) for i in ids], "chunk_id string, payload binary")
    got = transfer.fallback([src("ab", b"0"), src("bc", b"1"), src("cd", b"2")], src("abcx", b""))
    assert rows(got, "chunk_id", "origin") == [("a", 0), ("b", 0), ("c", 1)]
    assert rows(transfer.fallback([src("ab", b"0"), src("bc", b"1")]), "chunk_id", "origin") == [("a", 0), ("b", 0), ("c", 1)]
    primary = spark.createDataFrame([("a", 5), ("b", 5), ("c", 2)], "chunk_id string, length long")
    held = spark.createDataFrame([("h", 3)], "chunk_id string, length long")
    asks = spark.createDataFrame(list(enumerate("habacxb")), "ord long, chunk_id string")
    out = lambda budget: [r.outcome for r in transfer.cached_reads(asks, held, primary, budget).orderBy("ord").collect()]
    assert out(None) == ["hit", "miss_fill", "miss_fill", "hit", "miss_fill", "not_found", "hit"]
    assert out(10) == ["hit", "miss_fill", "miss_refused", "hit", "miss_fill", "not_found", "miss_refused"]
    r = transfer.cache_report(transfer.cached_reads(asks, held, primary, 10)).first()
    assert (r.cache_hits, r.cache_miss_fills, r.cache_miss_refused) == (2, 2, 2)


def test_listing_codecs(spark, tmp_path):
    entries = listed(spark, TREE, {"l": "a.txt"}, ["d"])
    data = listing_files.encode_dir(entries)
    assert listing_files.kind_of(data) == "cfdir" and struct.unpack_from("<H", data, 8)[0] == 2
    assert sorted(map(str, listing_files.decode_dir_frame(spark, data).collect())) == sorted(map(str, entries.collect()))
    assert struct.unpack_from("<H", listing_files.encode_dir(entries.where("kind <> 'symlink'")), 8)[0] == 1
    entry = listed(spark, {"b": b"12345678X"}).first()
    chunks = [(c.end_offset, c.chunk_id) for c in entry.chunks]
    index = listing_files.encode_index(9, entry.blob_id, chunks, ChunkParams(2, 4, 8))
    assert len(index) == 88 + 3 * 40 + 32
    back = listing_files.decode_index(index)
    assert (back["size"], back["blob_id"], back["chunks"], back["params"]) == (9, entry.blob_id, chunks, ChunkParams(2, 4, 8))
    (tmp_path / "t.cfdir").write_bytes(data)
    (tmp_path / "b.cfidx").write_bytes(index)
    every = listing_files.read_listings(spark, f"file://{tmp_path}/*.cf*")
    assert every.count() == len(TREE) + 3 and every.where("path = 'b'").first().size == 9
    listing_files.register(spark)
    assert spark.read.format("cflisting").load(f"{tmp_path}/*.cfdir").count() == len(TREE) + 2
    assert listing_files.write_dir(entries, str(tmp_path / "w.cfdir")) == len(data)
    with pytest.raises(FileExistsError):
        listing_files.write_dir(entries, str(tmp_path / "w.cfdir"))

    def broken(error, made, decode):
        with pytest.raises(error):
            list(decode(made) or ())

    flip = lambda d, i: d[:i] + bytes([d[i] ^ 1]) + d[i + 1 :]
    for d, decode in ((data, listing_files.decode_dir), (index, listing_files.decode_index)):
        broken(BadMagic, b"NOTMAGIC" + d[8:], decode)
        broken(UnsupportedMajor, flip(d, 7), decode)
        broken(Truncated, d[:20], decode)
        broken(TrailerMismatch, flip(d, len(d) - 1), decode)
        broken(UnsupportedFormatVersion, d[:8] + b"\x09\0" + d[10:], decode)
    broken(Truncated, index[:-1], listing_files.decode_index)
    with pytest.raises(InvalidStructure):
        listing_files.encode_index(8, entry.blob_id, chunks)
    with pytest.raises(InvalidStructure):
        listing_files.encode_entries([Row(path="a", kind="dir", mode=1), Row(path="a", kind="dir", mode=1)])
    with pytest.raises(InvalidPath):
        listing_files.encode_entries([Row(path="../a", kind="dir", mode=1)])


class _Server(http.server.BaseHTTPRequestHandler):
    held: dict[str, bytes] = {}
    failing = 0
    head = True

    def _answer(self, code, body=b""):
        self.send_response(code)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(body)

    def do_GET(self):
        if self.command == "HEAD" and not _Server.head:
            return self._answer(405)
        if _Server.failing > 0 and self.command == "GET":
            _Server.failing -= 1
            return self._answer(503)
        body = _Server.held.get(self.path)
        self._answer(200 if body is not None else 404, body or b"")

    do_HEAD = do_GET

    def do_PUT(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        if self.path in _Server.held:
            return self._answer(409)
        _Server.held[self.path] = body
        self._answer(201)

    def log_message(self, *a):
        pass


def test_http_store(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        end = remote.Endpoint(base, headers=("X-A: {prefix}",), policy=RetryPolicy(3, 0.001, 0.002))
        chunks = chunking.blob_payloads(blobs(spark, TREE), FIXED).distinct()
        n = chunks.count()
        assert end.reachable() and not remote.Endpoint("http://127.0.0.1:1", timeout=0.5).reachable()
        assert {r.outcome for r in remote.upload(chunks, end).collect()} == {"uploaded"} and len(_Server.held) == n
        assert {r.outcome for r in remote.upload(chunks, end).collect()} == {"skipped"}
        assert {r.outcome for r in remote.upload(chunks, end, skip_if_exists=False).collect()} == {"skipped"}
        _Server.head = False
        assert end.has(chunks.first().chunk_id) and not end.has("0" * 64)
        got = remote.fetch(chunks.select("chunk_id").unionByName(spark.createDataFrame([("0" * 64,)], "chunk_id string")), end)
        assert rows(got.groupBy("outcome").count()) == [("fetched", n), ("missing", 1)]
        _Server.failing = 2
        assert end.get(chunks.first().chunk_id)[1] == 2
        _Server.failing = 99
        assert {r.outcome for r in remote.fetch(chunks, end).collect()} == {"failed_transient"}
        _Server.failing = 0
        one = chunks.first().chunk_id
        _Server.held[f"/chunks/{one[:2]}/{one[2:]}.cnk"] = b"bad"
        assert {r.outcome for r in remote.fetch(chunks.where(F.col("chunk_id") == one), end).collect()} == {"failed_permanent"}
    finally:
        server.shutdown()


def test_streaming_archive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_bytes(b"12345678")
    s = store.Store.create(spark, f"file://{tmp_path}/store")
    run = lambda: incremental.watch(spark, f"file://{tmp_path}/in", s, f"file://{tmp_path}/entries", f"file://{tmp_path}/check", fixed=FIXED).awaitTermination()
    run()
    assert s.list().count() == 2
    (tmp_path / "in/b").write_bytes(b"1234zzzz")
    run()
    assert s.list().count() == 3
    entries = spark.read.parquet(f"{tmp_path}/entries")
    assert entries.count() == 2 and readpath.verify_report(readpath.verify(entries, s.chunks())).first().ok

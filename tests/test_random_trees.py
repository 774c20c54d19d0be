"""Differences, scopes and reuse on random listing pairs, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from cairnlake.functions.pathfilter import PathFilter
from cairnlake.operators import chunking, diff, listing, readpath, seed, store
from cairnlake.schema import ENTRIES

NAMES = ["a", "b", "ab", "a.o", "ü", "c-1"]


def random_entries(rng, n):
    out = {}
    for _ in range(n):
        path = "/".join(rng.choice(NAMES) for _ in range(rng.randrange(1, 4)))
        kind = rng.choice(["file", "file", "file", "symlink", "dir"])
        ids = [f"{rng.randrange(12):064x}" for _ in range(rng.randrange(4))] if kind == "file" else None
        chunks = [{"end_offset": 4 * (i + 1), "chunk_id": c} for i, c in enumerate(ids)] if ids is not None else None
        out[path] = (path, kind, rng.choice([420, 493]), 4 * len(ids) if ids is not None else None, rng.randrange(2) if kind == "file" else None, "".join(c[-2:] for c in ids).rjust(64, "0") if ids is not None else None, rng.choice(["x", "y"]) if kind == "symlink" else None, chunks)
    return list(out.values())


def plain_diff(left, right):
    a, b = ({e[0]: e for e in side if e[1] != "dir"} for side in (left, right))
    out = {}
    for p in a.keys() | b.keys():
        if p not in a:
            out[p] = "added"
        elif p not in b:
            out[p] = "removed"
        else:
            x, y = a[p], b[p]
            if x[1] != y[1] or (x[1] == "file" and (x[5], x[3]) != (y[5], y[3])) or (x[1] == "symlink" and x[6] != y[6]):
                out[p] = "changed"
            else:
                out[p] = "meta_changed" if x[2] != y[2] or (x[1] == "file" and x[4] != y[4]) else "same"
    return out


def chunk_set(entries):
    return {c["chunk_id"] for e in entries for c in e[7] or ()}


@pytest.mark.parametrize("seed_", range(6))
def test_diff_and_sets(spark, seed_):
    rng = random.Random(seed_)
    left, right = random_entries(rng, 60), random_entries(rng, 60)
    l, r = spark.createDataFrame(left, ENTRIES), spark.createDataFrame(right, ENTRIES)  # noqa: E741
    assert {x.path: x.category for x in diff.diff_paths(l, r).collect()} == plain_diff(left, right)
    a, b = chunk_set(left), chunk_set(right)
    s = diff.chunk_overlap(l, r).first()
    assert (s.chunks_shared, s.chunks_only_left, s.chunks_only_right) == (len(a & b), len(a - b), len(b - a))
    assert {x.chunk_id for x in listing.union_refs([l, r]).collect()} == a | b
    refs = [chunking.chunk_refs(x) for x in (l, r)]
    assert {x.chunk_id for x in store.unreferenced(refs[0].select("chunk_id").distinct(), refs[1]).collect()} == a - b
    assert {x.chunk_id for x in store.missing(refs[0], refs[1].select("chunk_id").distinct()).collect()} == a - b
    plan = seed.seed_plan(l, refs[1])
    want = sorted((c["chunk_id"], e[0], i, 4 * i) for e in left if e[1] == "file" for i, c in enumerate(e[7]) if c["chunk_id"] in b)
    assert sorted((x.chunk_id, x.path, x.ord, x.offset) for x in plan.collect()) == want


@pytest.mark.parametrize("seed_", range(6))
def test_scopes(spark, seed_):
    rng = random.Random(100 + seed_)
    entries = random_entries(rng, 80)
    pick = lambda: "/".join(rng.choice(NAMES) for _ in range(rng.randrange(1, 3)))
    scope = PathFilter(tuple(pick() for _ in range(rng.randrange(3))), tuple(rng.choice([pick(), pick() + "/", pick() + "*", "*" + pick()]) for _ in range(rng.randrange(3))))

    def allowed(p):
        def out(e):
            return p == e[:-1] or p.startswith(e) if e.endswith("/") else p.startswith(e[:-1]) if e.endswith("*") else p.endswith(e[1:]) if e.startswith("*") else p == e

        return (not scope.includes or any(p == i or p.startswith(i + "/") for i in scope.includes)) and not any(out(e) for e in scope.excludes)

    leaves = {e[0] for e in entries if e[1] != "dir" and allowed(e[0])}
    dirs = {e[0] for e in entries if e[1] == "dir" and (allowed(e[0]) or any(p.startswith(e[0] + "/") for p in leaves))}
    df = spark.createDataFrame(entries, ENTRIES)
    want = {e[0] for e in entries} if scope.empty else leaves | dirs
    assert {r.path for r in listing.filtered(df, scope).collect()} == want
    c = listing.scope_counts(df, scope).first()
    assert c.excluded == sum(1 for e in entries if e[1] != "dir" and not allowed(e[0]))
    assert listing.violations(df).count() == 0


@pytest.mark.parametrize("seed_", range(4))
def test_ranges(spark, seed_):
    rng = random.Random(200 + seed_)
    files = {f"f{i}": rng.randbytes(rng.randrange(60)) for i in range(8)}
    blobs = spark.createDataFrame([(p, "file", 420, len(b), 0, None, b) for p, b in files.items()], "path string, kind string, mode long, size long, mtime_secs long, target string, content binary")
    entries, stored = chunking.with_chunks(blobs, 7), chunking.blob_payloads(blobs, 7).distinct()
    off, n = rng.randrange(50), rng.randrange(1, 40)
    got = {}
    for r in readpath.read_range(entries, stored, off, n).orderBy("path", "start_offset").collect():
        got[r.path] = got.get(r.path, b"") + bytes(r.payload)
    assert got == {p: b[off : off + n] for p, b in files.items() if b[off : off + n]}
    assert readpath.folded(readpath.pieces(entries, stored)).agg(F.sum("size")).first()[0] == sum(map(len, files.values()))

import random
import re
from itertools import combinations

import numpy as np

from gleaner.llm import near_duplicates as nd


def words(t):
    return re.findall("[a-z0-9_]+", t.lower())


def shingles(t, n):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        t = [rng.choice(vocab) for _ in range(rng.randint(25, 90))]
        rows.append((f"a{i:03d}", f"f{i}", " ".join(t)))
        for k in range(rng.randint(0, 3)):
            u = list(t)
            for _ in range(rng.randint(0, 6)):
                u[rng.randrange(len(u))] = rng.choice(vocab)
            if rng.random() < 0.3:
                u = u[len(u) // 2 :] + u[: len(u) // 2]
            rows.append((f"b{i:03d}{k}", f"f{i if rng.random() < 0.2 else i + 100}", "\n".join(u).upper() if rng.random() < 0.3 else ", ".join(u)))
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "id string, grp string, text string, size string, k1 int")
    return nd.similar_sets(df, "id", "grp", "text", **({"threshold": 0.5, "shingle": 3, "least": 20} | kw))


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    rows += [(None, "f1", rows[0][2]), ("n1", "f1", None), ("n2", "f2", ""), ("n3", "f3", "too short"), rows[5], ("cp", None, rows[5][2])]
    got = {(r.a, r.b) for r in nd.pairs(*run(spark, rows)).collect()}
    unique = {r[0]: r for r in rows if r[0] and r[2] and len(words(r[2])) >= 20}
    sets = {i: shingles(r[2], 3) for i, r in unique.items()}
    want = {tuple(sorted(p)) for p in combinations(unique, 2) if unique[p[0]][1] != unique[p[1]][1] and jaccard(sets[p[0]], sets[p[1]]) >= 0.5}
    missed = want - got
    assert got <= want and len(missed) <= 0.02 * len(want)


def test_groups_and_links(spark):
    base = " ".join(f"x{i}" for i in range(40))
    edit = base.replace("x20", "y")
    far = " ".join(f"z{i}" for i in range(40))
    rows = [("a", "f1", base), ("b", "f2", edit), ("c", "f3", base.upper()), ("d", "f4", far)]
    got = {r.id: (r.group_id, r.links) for r in nd.groups(*run(spark, rows)).collect()}
    assert got == {"a": ("a", 1), "b": ("a", 1), "c": ("a", 1), "d": ("d", 0)}


def test_empty(spark):
    members, links = run(spark, [])
    assert nd.pairs(members, links).count() == 0 and nd.groups(members, links).count() == 0


def test_exact_way_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nd, "EXACT_TILE", 16)
    rows = corpus()
    got = {(r.a, r.b) for r in nd.pairs(*run(spark, rows, exact=True)).collect()}
    sets, group = {r[0]: shingles(r[2], 3) for r in rows}, {r[0]: r[1] for r in rows}
    assert got == {tuple(sorted(p)) for p in combinations(sets, 2) if group[p[0]] != group[p[1]] and jaccard(sets[p[0]], sets[p[1]]) >= 0.5}


def test_copies_of_one_file_keep_their_pairs(spark, monkeypatch):
    """Copies within one file and an edited copy in another: each copy is paired with it, whatever their number."""
    base = " ".join(f"x{i}" for i in range(30))
    rows = [(f"i{k:04d}", "f", base) for k in range(150)] + [("z", "g", base.replace("x15", "y"))]
    want = {(f"i{k:04d}", "z") for k in range(150)}
    assert {(r.a, r.b) for r in nd.pairs(*run(spark, rows)).collect()} == want
    monkeypatch.setattr(nd, "EXPAND", 100)
    assert {(r.a, r.b) for r in nd.pairs(*run(spark, rows)).collect()} == want
    members = nd.groups(*run(spark, rows)).collect()
    assert {r.class_id for r in members if r.grp == "f"} == {"i0000"} and len({r.group_id for r in members}) == 1


def test_shared_keys_over_batches():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = sorted((int(k), int(v)) for k, v in zip(rng.integers(0, 60, 300), rng.integers(0, 3, 300) * 1000 + rng.integers(0, 2, 300), strict=True) if k % 3 or v < 1000)
    rows = sorted(rows + [(100, 1), (100, 1), (100, 1), (101, 5), (102, 1), (102, 2)])
    want = sorted({r for r in rows if len({v for k, v in rows if k == r[0]}) > 1})
    for size in (1, 2, 7, 1000):
        parts = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[i : i + size]]), pa.array([v for _, v in rows[i : i + size]])], ["key", "k1"]) for i in range(0, len(rows), size)]
        got = [(k, v) for b in nd._shared_keys(iter(parts)) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        assert got == want


def test_large_group_of_copies_is_a_star(spark, monkeypatch):
    monkeypatch.setattr(nd, "EXPAND", 4096)
    base = " ".join(f"x{i}" for i in range(30))
    rows = [(f"i{k:04d}", f"f{k % 50}", base) for k in range(100)]
    got = {(r.a, r.b) for r in nd.pairs(*run(spark, rows)).collect()}
    assert {x for p in got for x in p} == {r[0] for r in rows} and len(got) < 300
    group = {r[0]: r[1] for r in rows}
    assert all(group[a] != group[b] for a, b in got)
    assert nd.groups(*run(spark, rows)).select("group_id").distinct().count() == 1


def test_hot_band_is_split_without_loss(spark, monkeypatch):
    """Texts that share most of their shingles meet in the same bands; splitting a band changes no result."""
    common = [f"k{i}" for i in range(60)]
    rows = [(f"i{k:03d}", f"f{k}", " ".join([*common, *(f"u{k}_{j}" for j in range(6))])) for k in range(90)]
    whole = {(r.a, r.b) for r in nd.pairs(*run(spark, rows)).collect()}
    monkeypatch.setattr(nd, "SAMPLE", 2)
    monkeypatch.setattr(nd, "HOT", 16)
    split = {(r.a, r.b) for r in nd.pairs(*run(spark, rows)).collect()}
    assert whole == split == {(a[0], b[0]) for a, b in combinations(rows, 2)}


def test_sketch_difference_never_exceeds_the_true_one():
    """The radius test loses nothing: bit counts are at most the symmetric difference."""
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = rng.integers(0, 1 << 62, 200, dtype=np.uint64)
        b = np.concatenate([a[: rng.integers(50, 200)], rng.integers(0, 1 << 62, rng.integers(1, 120), dtype=np.uint64)])
        bits = [np.packbits((np.bincount((s & np.uint64(255)).astype(int), minlength=256) & 1).astype(np.uint8)).view(np.uint64) for s in (np.unique(a), np.unique(b))]
        true = len(set(a.tolist()) ^ set(b.tolist()))
        assert int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= true


def test_tiles_apart_in_population_are_skipped():
    size = np.array([10, 12]), np.array([100, 120])
    zero = np.zeros((2, 4), np.uint64)
    i, _ = nd.compare_tiles((size[0], zero), (size[1], zero), 1 / 3, False)
    assert len(i) == 0
    i, j = nd.compare_tiles((size[0], zero), (size[0], zero), 1 / 3, True)
    assert list(zip(i, j, strict=True)) == [(0, 1)]


def test_pairs_at_the_default_threshold(spark):
    rows = []
    for p in range(8):  # 9 words each, 8 in common: 8 / 10
        common = [f"w{p}x{i}" for i in range(8)]
        rows += [(f"{p}a", f"f{p}a", " ".join([*common, f"only{p}a"])), (f"{p}b", f"f{p}b", " ".join([*common, f"only{p}b"]))]
    df = spark.createDataFrame(rows, "id string, grp string, text string")
    got = nd.pairs(*nd.similar_sets(df, "id", "grp", "text", shingle=1, least=5))
    assert {(r.a, r.b) for r in got.collect()} == {(f"{p}a", f"{p}b") for p in range(8)}

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import analytics as A
from gleaner.operators.graph import connected_components
from gleaner.operators.vector_join import similarity_join
from gleaner.plans import organize


def components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", range(4))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(f"{rng.randint(0, 150):03d}", f"{rng.randint(0, 150):03d}") for _ in range(rng.randint(1, 160))]
    edges += [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(40)] + [("hub", f"l{i:02d}") for i in range(30)]
    df = spark.createDataFrame([*edges, (None, "000"), edges[0]], "a string, b string")
    got = {r.vertex: r.component for r in connected_components(df).collect()}
    assert got == {x: c for x, c in components([e for e in edges if e[0] != e[1]]).items()}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([("a", "a")], "a string, b string")).count() == 0


def test_similarity_join_is_exact(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([c + 0.15 * rng.normal(size=(60, 6)) for c in rng.normal(size=(8, 6))])
    rows = [(f"i{i:04d}", [float(v) for v in x[i]], "q") for i in range(len(x))] + [("dup", [float(v) * 3 for v in x[0]], "q"), ("z", [0.0] * 6, "q"), ("n", None, "q"), (None, [1.0] * 6, "q"), ("s", [1.0], "q")]
    df = spark.createDataFrame(rows, "id string, v array<float>, a string")
    pairs, members = similarity_join(df, "id", "v", 0.97, dim=6, block=40, sample=200)
    member = {r.id: r["class"] for r in members.collect()}
    assert set(member) == {r[0] for r in rows[:-4]} and member["dup"] == member["i0000"]
    got = {(r.a, r.b) for r in pairs.collect()}
    f = x.astype(np.float32).astype(np.float64)
    u = f / np.linalg.norm(f, axis=1, keepdims=True)
    s = u @ u.T
    name = [member[f"i{i:04d}"] for i in range(len(x))]
    want = {tuple(sorted((name[i], name[j]))) for i in range(len(x)) for j in range(i) if s[i, j] >= 0.97 + 1e-7}
    near = {tuple(sorted((name[i], name[j]))) for i in range(len(x)) for j in range(i) if s[i, j] >= 0.97 - 1e-6}
    assert want <= got <= near and len(want) > 100
    assert similarity_join(df.limit(0), "id", "v", 0.9, dim=6)[0].count() == 0


def test_greedy_equals_the_loop(spark):
    rng = random.Random(3)
    names = [f"f{i:02d}" for i in range(30)]
    edges = sorted({tuple(sorted(rng.sample(names, 2))) for _ in range(60)} | {(f"p{i:02d}", f"p{i + 1:02d}") for i in range(15)})
    sizes = {n: rng.randint(1, 5) for n in names + [f"p{i:02d}" for i in range(16)]}
    used, want = set(), set()
    for a, b in edges:
        if not {a, b} & used:
            used |= {a, b}
            want.add((b, a, sizes[a]) if sizes[b] > sizes[a] else (a, b, sizes[b]))
    df = spark.createDataFrame([(a, b, 0.97) for a, b in edges], "a string, b string, cosine double")
    out = A.greedy_groups(df, spark.createDataFrame(list(sizes.items()), "path string, size long"))
    assert {(r.representative, r.duplicate, r.wasted) for r in out.collect()} == want
    total = A.duplicate_totals(out).first()
    assert (total.duplicates, total.wasted) == (len(want), sum(w for *_, w in want))
    three = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0)], df.schema)
    assert A.greedy_groups(three, spark.createDataFrame([], "path string, size long")).count() == 1
    assert {r.group_path for r in A.duplicate_components(three).collect()} == {"a"}


def test_centroids(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [0.0, 0.0]), ("c", None), (None, [1.0, 1.0]), ("d", [1.0])], "file_path string, embedding array<float>")
    got = {r.path: r.centroid for r in A.file_centroids(df, dim=2).collect()}
    assert set(got) == {"a", "b"} and got["a"] == pytest.approx([2**-0.5, 2**-0.5]) and got["b"] == [0.0, 0.0]


def test_kmeans(spark):
    df = spark.createDataFrame([(f"a{i}", [1.0, 0.01 * i]) for i in range(5)] + [(f"b{i}", [0.01 * i, 1.0]) for i in range(5)] + [(None, [1.0, 1.0]), ("n", None)], "id string, v array<float>")
    topics, centres = A.kmeans_topics(df, "id", "v", 2, dim=2)
    got = {r.id: r.topic for r in topics.collect()}
    assert len(got) == 10 and len({got[f"a{i}"] for i in range(5)}) == 1 and got["a0"] != got["b0"] and len(centres) == 2
    assert len(A.kmeans_topics(df.limit(1), "id", "v", 5, dim=2)[1]) == 1
    assert A.kmeans_topics(df.limit(0), "id", "v", 5, dim=2)[0].count() == 0
    with pytest.raises(ValueError):
        A.kmeans_topics(df, "id", "v", 0)


def test_categories(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [0.7, 0.7])], "id string, v array<float>")
    got = {r.id: r.category for r in A.assign_categories(df, {"x": [1.0, 0.0], "y": [0.0, 1.0]}, "id", "v").collect()}
    assert got == {"a": "x", "b": None, "c": "y"}
    assert A.assign_categories(df, {}, "id", "v").where("category is null").count() == 3


def test_cleanup_and_plans(spark):
    rows = [("/p/a.txt", 5, "2026-01-01"), ("/p/b.tmp", 5, "2026-01-01"), ("/p/e.md", 0, "2026-01-01"), ("/p/build/x.js", 3, "2026-01-01"), ("/p/old.md", 3, "2020-01-01"), ("/p/dup.md", 3, "2026-01-01"), (None, 1, None)]
    files = spark.createDataFrame(rows, "path string, size_bytes long, m string").selectExpr("path", "size_bytes", "to_timestamp(m) modified_at", "'text/plain' mime_type", "'indexed' status")
    dup = spark.createDataFrame([("/p/a.txt", "/p/dup.md")], "representative string, duplicate string")
    got = {r.path: r.reason for r in A.cleanup_candidates(files, dup, "2026-02-01").collect()}
    assert got == {"/p/b.tmp": "temporary", "/p/e.md": "empty", "/p/build/x.js": "generated", "/p/old.md": "stale", "/p/dup.md": "duplicate"}
    plan = organize.by_type(files, "/p")
    assert {r.target for r in plan.where("action = 'mkdir'").collect()} == {"/p/txt", "/p/tmp", "/p/md", "/p/js"}
    i = organize.impact(plan).first()
    assert (i.dirs_created, i.files_moved, i.files_deleted) == (4, 6, 0)
    assert organize.by_type(files, "/none").count() == 0
    assert {r.target for r in organize.by_project(files, "/p").collect()} == {"/p/build"}
    assert organize.impact(organize.deletions(A.cleanup_candidates(files, dup))).first().files_deleted == 4


def test_global_index(spark):
    df = spark.createDataFrame([(f"{i:03d}",) for i in random.Random(1).sample(range(200), 200)], "k string")
    got = {r.k: r.position for r in A.global_index(df, "k").collect()}
    assert got == {f"{i:03d}": i for i in range(200)}


def test_greedy_settles_large_groups_and_chains(spark):
    group = [f"g{i:03d}" for i in range(220)]
    chain = [f"h{i:03d}" for i in range(221)]
    edges = [(a, b) for i, a in enumerate(group) for b in group[i + 1 :]] + list(zip(chain, chain[1:], strict=False))
    df = spark.createDataFrame([(a, b, 0.97) for a, b in edges], "a string, b string, cosine double")
    out = A.greedy_groups(df, spark.createDataFrame([], "path string, size long"))
    want = {(x[i], x[i + 1]) for x in (group, chain) for i in range(0, 220, 2)}
    assert {(r.representative, r.duplicate) for r in out.collect()} == want


def test_greedy_uses_copies(spark):
    rng = random.Random(8)
    classes = [f"c{i}" for i in range(12)]
    near = {tuple(sorted(rng.sample(classes, 2))) for _ in range(9)}
    own = {f"{rng.randint(0, 999):03d}-{c}-{j}": c for c in classes for j in range(rng.randint(1, 7))}
    first = {c: min(f for f in own if own[f] == c) for c in classes}
    used, want = set(), set()
    for a in sorted(own):
        for b in sorted(own):
            if a < b and not {a, b} & used and (own[a] == own[b] or tuple(sorted((own[a], own[b]))) in near):
                used |= {a, b}
                want.add((a, b, 1.0 if own[a] == own[b] else 0.96))
    df = spark.createDataFrame([(*sorted((first[a], first[b])), 0.96) for a, b in near], "a string, b string, cosine double")
    members = spark.createDataFrame([(f, first[c]) for f, c in own.items()], "id string, class string")
    sizes = spark.createDataFrame([(f, 10) for f in own], "path string, size long")
    assert {(r.representative, r.duplicate, r.cosine) for r in A.greedy_groups(df, sizes, members).collect()} == want


def test_queries_pair_exact_copies(spark, tmp_path):
    from gleaner import queries as Q

    vec = [1.0, 2.0] + [0.0] * 62
    chunks = [(f"/d/{n}", vec) for n in ("a", "b", "c", "d", "e")] + [("/d/z", vec[::-1])]
    spark.createDataFrame([(f"{p}#0", p, v) for p, v in chunks], "chunk_id string, file_path string, embedding array<float>").withColumn("indexed_at", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/chunks.parquet")
    files = spark.createDataFrame([(p, 100) for p, _ in chunks], "path string, size_bytes long").withColumn("modified_at", F.lit("2024-01-01").cast("timestamp"))
    files.write.parquet(f"{tmp_path}/files.parquet")
    got = {(r.representative, r.duplicate, r.cosine, r.wasted) for r in Q.duplicate_groups_greedy(spark, str(tmp_path)).collect()}
    assert got == {("/d/a", "/d/b", 1.0, 100), ("/d/c", "/d/d", 1.0, 100)}

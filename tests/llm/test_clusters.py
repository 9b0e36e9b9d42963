import numpy as np

from gleaner.llm import clusters


def brute(x, names, least, t):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= t
    seen, out = set(), {}
    for i in range(len(x)):
        if i in seen:
            continue
        part, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(link[todo.pop()]):
                if j not in part:
                    part.add(int(j))
                    todo.append(int(j))
        seen |= part
        if len(part) >= least:
            first = min(names[j] for j in part)
            out |= {names[j]: first for j in part}
    return out


def test_link_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    parts = [rng.normal(size=16) * 3 + rng.normal(size=(n, 16)) * 0.9 for n in (150, 60, 20, 6, 4)]
    x = np.vstack([*parts, rng.normal(size=(40, 16))]).astype(np.float32)
    names = [f"/p/{i:04d}" for i in rng.permutation(len(x))]
    rows = [(f"c{i}", names[i], [float(v) for v in x[i]], "q") for i in range(len(x))]
    rows += [rows[0], ("n1", None, [1.0] * 16, "q"), ("n2", "/p/none", [0.0] * 16, "q"), ("n3", "/p/none", None, "q"), (None, "/p/none", [1.0] * 16, "q")]
    df = spark.createDataFrame(rows, "id string, path string, v array<float>, g string")
    vectors = clusters.group_vectors(df, "id", "path", "v", 16)
    assert vectors.count() == len(x)
    for k in (2, 12):  # too few centroids as well: what no core explains is compared with everything
        got = {r.id: r.cluster for r in clusters.link_clusters(vectors, 0.6, 5, k=k, core=8, dim=16).collect()}
        assert got == brute(x.astype(np.float64), names, 5, 0.6)
    sizes = {r.cluster: (r["size"], r.typical) for r in clusters.describe(vectors, clusters.link_clusters(vectors, 0.6, 5, k=12, core=8, dim=16), 16, 3).collect()}
    want = brute(x.astype(np.float64), names, 5, 0.6)
    assert {c: n for c, (n, _) in sizes.items()} == {c: list(want.values()).count(c) for c in want.values()}
    assert all(len(t) == 3 and all(want[m] == c for m in t) for c, (_, t) in sizes.items())


def test_mean_of_unit_vectors(spark):
    df = spark.createDataFrame([("a", "f", [2.0, 0.0]), ("b", "f", [0.0, 1.0]), ("c", "g", [1.0, 0.0]), ("d", "g", [-1.0, 0.0])], "id string, p string, v array<float>")
    got = {r.id: np.frombuffer(bytes(r.v), np.float32) for r in clusters.group_vectors(df, "id", "p", "v", 2).collect()}
    assert set(got) == {"f"} and np.allclose(got["f"], [2**-0.5, 2**-0.5])


def test_empty(spark):
    df = spark.createDataFrame([], "id string, p string, v array<float>")
    vectors = clusters.group_vectors(df, "id", "p", "v", 4)
    assert clusters.link_clusters(vectors, dim=4).count() == 0


def test_blocks_of_unexplained_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 4)).astype(np.float32)
    df = spark.createDataFrame([(f"i{i:02d}", [float(v) for v in x[i]]) for i in range(50)], "id string, v array<float>")
    vectors = clusters.group_vectors(df.withColumn("p", df.id), "id", "p", "v", 4)
    got = {r.id: r.cluster for r in clusters.link_clusters(vectors, 0.9, 2, k=3, core=2, dim=4, block=7).collect()}
    assert got == brute(x.astype(np.float64), [f"i{i:02d}" for i in range(50)], 2, 0.9)


def test_text_vectors(spark):
    df = spark.createDataFrame([(1, "red apple tree"), (2, "red apple tree"), (3, "engine oil pump"), (4, None), (5, "")], "id int, t string")
    got = {r.id: np.array(r.vector) for r in clusters.text_vectors(df, "id", "t", 32).collect()}
    assert np.allclose(got["1"], got["2"]) and abs(got["1"] @ got["3"]) < got["1"] @ got["1"]
    assert not got["4"].any() and not got["5"].any()


def test_links_of_rows_that_come_near_one_core_only(spark):
    rng = np.random.default_rng(6)
    a, b, t = np.eye(16)[0], np.eye(16)[1], np.eye(16)[2]
    x = np.vstack([a + 0.02 * rng.normal(size=(30, 16)), b + 0.02 * rng.normal(size=(30, 16)), 0.64 * a + 0.768 * t, 0.64 * b + 0.768 * t, -a + 0.02 * rng.normal(size=(9, 16))])
    df = spark.createDataFrame([(f"i{i:02d}", [float(v) for v in x[i]]) for i in range(len(x))], "id string, v array<float>")
    vectors = clusters.group_vectors(df.withColumn("p", df.id), "id", "p", "v", 16)
    want = brute(x, [f"i{i:02d}" for i in range(len(x))], 5, 0.575)
    assert sorted(want.values()).count("i00") == 62 and len(want) == 71
    got = {r.id: r.cluster for r in clusters.link_clusters(vectors, 0.575, 5, k=3, core=4, dim=16).collect()}
    assert got == want

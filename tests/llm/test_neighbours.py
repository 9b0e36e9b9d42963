import numpy as np
import pytest

from gleaner.llm.neighbours import MultiIndex, similar_vectors


def brute(rows, k):
    """The definition, row by row: ``rows`` are (id, group, vector)."""
    seen = {}
    for i, g, v in rows:
        if i is not None and v is not None and np.linalg.norm(v) > 0:
            seen[i] = (g, np.asarray(v, np.float64) / np.linalg.norm(v))
    out = {}
    for i, (g, v) in seen.items():
        scored = sorted((-round(float(v @ w), 6), j) for j, (h, w) in seen.items() if h != g)
        out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def collect(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.id, []).append((r["rank"], r.neighbour, r.cosine))
    return {i: [(n, c) for _, n, c in sorted(v)] for i, v in out.items()}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 8)).astype(np.float32)
    rows = [(f"c{i:04d}", f"f{i % 37}", [float(x) for x in base[i]]) for i in range(400)]
    rows += [(f"d{i:04d}", f"g{i}", [float(x) * 2 for x in base[7]]) for i in range(30)]  # one direction in many files
    rows += [(f"e{i:04d}", "f5", [float(x) for x in base[9]]) for i in range(12)]  # copies within a file
    rows += [("z0", "f1", [0.0] * 8), ("z1", "f1", None), (None, "f1", [1.0] * 8), ("z2", "f2", [1.0, 2.0]), rows[3]]
    return rows


SCHEMA = "id string, grp string, vec array<float>, rank string, v string"


def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = collect(similar_vectors(df, "id", "grp", "vec", k=5, dim=8, candidates=10_000, block=64))
    want = brute(rows[:-5] + [rows[3]], 5)
    assert set(got) == set(want)
    for i in want:
        assert [c for _, c in got[i]] == pytest.approx([c for _, c in want[i]], abs=2e-6)
        assert {n for n, c in got[i] if c > want[i][-1][1] + 1e-5} <= {n for n, _ in want[i]}
    assert [n for n, _ in got["d0000"]] == [n for n, _ in want["d0000"]]  # ties by the smaller id


def test_min_cosine_is_a_filter(spark, rows):
    df = spark.createDataFrame([r[:3] for r in rows], "id string, grp string, vec array<float>")
    whole = collect(similar_vectors(df, "id", "grp", "vec", k=3, dim=8, candidates=10_000, block=64))
    part = collect(similar_vectors(df, "id", "grp", "vec", k=3, dim=8, candidates=10_000, block=64, min_cosine=0.9))
    assert part == {i: kept for i, v in whole.items() if (kept := [x for x in v if x[1] >= 0.9])}


def test_empty_and_lonely(spark):
    schema = "id string, grp string, vec array<float>"
    assert similar_vectors(spark.createDataFrame([], schema), "id", "grp", "vec", dim=4).count() == 0
    one = spark.createDataFrame([("a", "f", [1.0, 0.0, 0.0, 0.0]), ("b", "f", [1.0, 0.0, 0.0, 0.0])], schema)
    assert similar_vectors(one, "id", "grp", "vec", dim=4).count() == 0
    two = spark.createDataFrame([("a", "f", [1.0, 0.0, 0.0, 0.0]), ("b", None, [2.0, 0.0, 0.0, 0.0])], schema)
    assert collect(similar_vectors(two, "id", "grp", "vec", dim=4)) == {"a": [("b", 1.0)], "b": [("a", 1.0)]}


def test_heap_visits_cells_in_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    index = MultiIndex.fit(x, 8, 1)
    cells = index.cells(x)
    used, count = np.unique(cells, return_counts=True)
    index.pack(used, count, 10, 1)
    q = x[:5]
    d1 = ((q[:, None, :3] - index.left[None]) ** 2).sum(2)
    d2 = ((q[:, None, 3:] - index.right[None]) ** 2).sum(2)
    for r, seen in enumerate(index.visited(q, 50)):
        order = np.argsort((d1[r][:, None] + d2[r][None, :]).reshape(-1), kind="stable")
        order = order[index.population[order] > 0]
        n = int(np.searchsorted(np.cumsum(index.population[order]), 50)) + 1
        assert seen == set(index.block[order[:n]].tolist())


def test_recall_on_sampled_queries(spark):
    """With a narrow search, recall against brute force stays above 0.9."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 3000)] + 0.5 * rng.normal(size=(3000, 16))).astype(np.float32)
    rows = [(f"i{i:05d}", f"f{i}", [float(v) for v in x[i]]) for i in range(len(x))]
    df = spark.createDataFrame(rows, "id string, grp string, vec array<float>")
    got = collect(similar_vectors(df, "id", "grp", "vec", k=5, dim=16, candidates=400, block=256))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for i in range(0, len(x), 100):
        s = u @ u[i]
        s[i] = -2
        true = {f"i{j:05d}" for j in np.argsort(-s)[:5]}
        hit += len(true & {n for n, _ in got[f"i{i:05d}"]})
        total += 5
    assert hit / total >= 0.9


def test_own_rows_do_not_count_towards_the_candidates(spark):
    rng = np.random.default_rng(9)
    centre = np.eye(8)[0]
    hot = [(f"h{i:04d}", "hot", [float(x) for x in centre + 0.2 * rng.normal(size=8)]) for i in range(1500)]
    mid = [(f"m{i:04d}", "mid", [float(x) for x in np.eye(8)[3] + 0.2 * rng.normal(size=8)]) for i in range(9)]
    other = [(f"o{i:04d}", f"f{i % 20}", [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    df = spark.createDataFrame(hot + mid + other, "id string, grp string, vec array<float>")
    got, want = collect(similar_vectors(df, "id", "grp", "vec", 5, dim=8, candidates=100, block=40)), brute(hot + mid + other, 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    asked = [i for i in want if i[0] == "h"]
    assert np.mean([len({n for n, _ in got[i]} & {n for n, _ in want[i]}) / 5 for i in asked]) > 0.95
    alone = spark.createDataFrame(hot, df.schema)
    assert similar_vectors(alone, "id", "grp", "vec", 5, dim=8, candidates=100, block=40).count() == 0

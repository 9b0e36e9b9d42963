import random
import re

import pytest

from gleaner.llm import splitting


def check(text, limit=200, overlap=40):
    data = text.encode()
    parts = splitting.split(text, limit, overlap)
    edges = [0, *(m.end() for m in re.finditer(rb"\n|[.!?](?=[ \t\r\n])", data)), len(data)]
    assert b"".join(data[f:e] for _, e, f, _ in parts) == data
    for k, (s, e, f, natural) in enumerate(parts):
        assert 0 < e - s <= limit and s <= f and f - s <= overlap
        data[s:e].decode()
        if k:
            assert parts[k - 1][0] < s and f == parts[k - 1][1]
        assert natural == (e in edges)
        if not natural:  # no boundary was in reach
            assert not any(f < x <= s + limit for x in edges)
    assert splitting.is_forced(data, limit) == any(b - a > limit for a, b in zip(edges, edges[1:], strict=False))
    return parts


def test_random_texts():
    rng = random.Random(3)
    for _ in range(150):
        bits = ["word ", "Wört. ", "漢字", "🙂", "end.\n", "x" * rng.randint(1, 300), "line\r\n", "what? ", "a.b "]
        check("".join(rng.choice(bits) for _ in range(rng.randint(0, 120))))


def test_cut_falls_where_the_topic_changes():
    a = " ".join(f"The cat chased the mouse near the barn number {i}." for i in range(6)) + " "
    b = " ".join(f"Interest rates and bond yields moved in quarter {i}." for i in range(6))
    text = a + b
    parts = splitting.split(text, int(len(text) * 0.7), 0)
    assert parts[0][1] == len(a) - 1


def test_small_and_empty():
    assert splitting.split("") == [] and splitting.split("abc") == [(0, 3, 0, True)]
    with pytest.raises(ValueError):
        splitting.split("abc", 10, 5)


def test_table(spark):
    long = "One sentence. " * 400
    rows = [("a", long, "p", 0, "x"), ("a", long, "p", 0, "x"), ("b", "z" * 5000, "p", 1, "x"), ("c", "short", "p", 2, "x"), ("d", None, "q", 0, "x"), (None, long, "q", 1, "x"), ("e", "", None, None, "x")]
    df = spark.createDataFrame(rows, "chunk_id string, content string, file_path string, chunk_index int, id string")
    out = splitting.split_oversized(df).collect()
    assert {(r.id, r.forced) for r in out} == {("a", 0), ("b", 1)}
    assert all(len(r.content.encode()) == r.end_byte - r.start_byte <= 4096 for r in out)
    assert "".join(r.content[r.fresh_byte - r.start_byte :] for r in sorted(out, key=lambda r: r.piece) if r.id == "a") == long
    again = splitting.reindex(df, splitting.split_oversized(df, with_content=False))
    by = {}
    for r in again.collect():
        by.setdefault(r.file_path, []).append((r.chunk_index, r.chunk_id, r.piece))
    assert [i for i, _, _ in sorted(by["p"])] == list(range(len(by["p"])))
    assert [(c, p) for _, c, p in sorted(by["p"])] == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("c", 0)]
    empty = spark.createDataFrame([], df.schema)
    assert splitting.split_oversized(empty).count() == 0


def test_level_similarity_takes_linear_time():
    """Equal lines keep the similarity level throughout; climbing anew at each boundary would take hours here."""
    import time

    text = "alpha beta\n" * 180_000
    began = time.time()
    pieces = splitting.split(text)
    assert time.time() - began < 60
    assert pieces[-1][1] == len(text) and all(a[1] == b[2] for a, b in zip(pieces, pieces[1:], strict=False))

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner.functions import paths, text, vectors


def test_cosine_edge_cases(spark):
    rows = [([1.0, 0, 0], [1.0, 0, 0]), ([1.0, 0, 0], [0, 1.0, 0]), ([1.0, 0, 0], [-1.0, 0, 0]), ([0.0, 0, 0], [1.0, 0, 0]), ([1.0, 0], [1.0, 0, 0]), (None, [1.0, 0, 0])]
    df = spark.createDataFrame([([float(x) for x in a] if a else None, [float(x) for x in b]) for a, b in rows], "a array<float>, b array<float>")
    got = [r.c for r in df.select(vectors.cosine("a", "b").alias("c")).collect()]
    assert got == [1.0, 0.0, -1.0, 0.0, 0.0, 0.0]
    assert [r.c for r in df.select(vectors.cosine_clamped("a", "b").alias("c")).collect()] == got


def test_metrics(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0])], "a array<float>, b array<float>")
    r = df.select(vectors.dot("a", "b").alias("d"), vectors.l2sq("a", "b").alias("l"), vectors.metric_score("l2", "a", "b").alias("s"), vectors.l2_normalize("a").alias("n")).first()
    assert (r.d, r.l, r.s) == (13.0, 13.0, -12.0) and math.isclose(sum(x * x for x in r.n), 1)
    with pytest.raises(ValueError):
        vectors.metric_score("max", "a", "b")


def test_hash_embed_is_of_the_digest(spark):
    import hashlib

    df = spark.createDataFrame([("hello",), ("",), (None,)], "t string")
    got = [r.v for r in df.select(vectors.hash_embed("t", 40).alias("v")).collect()]
    want = [b / 255 - 0.5 for b in hashlib.sha256(b"hello").digest()]
    assert got[0] == pytest.approx([want[i % 32] for i in range(40)], abs=1e-6) and len(got[1]) == 40 and got[2] is None


def test_globs():
    hit = lambda g, p: bool(re.match(paths.glob_to_regex(g), p))
    assert hit("**/.git/**", "a/.git/config") and hit("**/.git/**", ".git/x") and not hit("**/.git/**", "a/.github/x")
    assert hit("**/*.lock", "x/y.lock") and hit("**/*.lock", "y.lock") and not hit("**/*.lock", "y.lock.txt")
    assert hit("**/.*", "a/.env") and not hit("**/.*", "a/b.env")
    assert hit("src/**", "src/a/b.rs") and not hit("src/**", "lib/src/a")
    assert hit("*.pyc", "a/b/c.pyc") and hit("a?c", "x/abc") and not hit("a?c", "a/c")


def test_path_types(spark):
    names = ["a.rs", "a.py", "a.tsx", "a.h", "a.md", "a.markdown", "a.txt", "a", "Makefile", "a.PDF", ".hidden", "x/.y.js"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = {r.p: (r.c, r.s) for r in df.select("p", paths.content_type_of(F.col("p")).alias("c"), paths.content_type_of(F.col("p"), True).alias("s")).collect()}
    assert got["a.rs"] == ("code:rust", "code:rust") and got["a.tsx"][0] == "code:typescript" and got["a.h"][0] == "code:c"
    assert got["a.md"][0] == got["a.markdown"][0] == "markdown" and got["a.txt"] == ("code:txt", "text") and got["a"][0] == got["Makefile"][0] == got[".hidden"][0] == "text"
    mimes = {r.p: r.m for r in df.select("p", paths.mime_of(F.col("p")).alias("m")).collect()}
    assert mimes["a.PDF"] == "application/pdf" and mimes["a"] == "text/plain" and mimes["a.md"] == "text/markdown"


def test_scope(spark):
    df = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",)], "p string")
    assert [r.x for r in df.select(paths.in_scope(F.col("p"), "/a/").alias("x")).collect()] == [True, True, False]


def test_text_positions(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("aä漢\n.🙂 ") for _ in range(30)), rng.randint(0, 30)) for _ in range(50)]
    df = spark.createDataFrame(rows, "t string, o int")
    for r in df.select("*", text.byte_of(F.col("t"), F.col("o")).alias("b"), text.line_of(F.col("t"), F.col("o")).alias("l")).collect():
        assert r.b == len(r.t[: r.o].encode()) and r.l == r.t[: r.o].count("\n")


def test_snippets_and_headings(spark):
    df = spark.createDataFrame([("ab\ncd" * 5,), ("short",), ("## Two",), ("#No",), ("####### seven",), (None,)], "t string")
    rows = df.select(text.snippet(F.col("t"), 10).alias("s"), text.preview(F.col("t"), 10).alias("p"), text.heading_level(F.col("t")).alias("h")).collect()
    assert rows[0].s == "ab cdab..." and rows[0].p == "ab\ncdab\ncd..." and rows[1].s == rows[1].p == "short"
    assert [r.h for r in rows] == [None, None, 2, None, None, None]


def test_paragraph_offsets(spark):
    t = "one ä\n\n \n\none ä\n\ntwo"
    got = spark.createDataFrame([(t,)], "t string").select(text.paragraphs(F.col("t")).alias("p")).first().p
    assert [(p.text, p.byte_offset) for p in got] == [("one ä", 0), ("one ä", 11), ("two", 19)]


def test_titles_and_pages(spark):
    df = spark.createDataFrame([("Annual Report Of Things",), ("this is plain prose that goes on and on.",), ("One\nTwo",), ("a\fb\fc",), ("x" * 7000,)], "t string")
    rows = df.select(text.is_title_line(F.col("t")).alias("x"), text.page_estimate(F.col("t")).alias("n")).collect()
    assert [r.x for r in rows[:3]] == [True, False, False] and [r.n for r in rows] == [1, 1, 1, 3, 2]

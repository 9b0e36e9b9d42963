import math
import re

import numpy as np
import pytest

from gleaner.operators import embedding, fulltext, search
from gleaner.plans import dsl


def test_parse():
    q = dsl.parse("authentication lang:rust path:src/** limit:5")
    assert (q.text, q.limit) == ("authentication", 5) and q.filters == [dsl.Filter("language", "rust"), dsl.Filter("glob", "src/**")]
    assert dsl.parse("how to implement auth").text == "how to implement auth" and dsl.parse("").text == ""
    assert dsl.parse("path:src/lib").filters == [dsl.Filter("path", "src/lib")]
    assert dsl.parse("DEPTH:2 search term") == dsl.Query("search term", [dsl.Filter("max_depth", 2)], 10)
    assert dsl.parse("limit:abc search").limit == 10 and dsl.parse("limit:3 limit:7 x").limit == 7
    assert dsl.parse("unknown:value search").text == "unknown:value search" and dsl.parse("depth:999").filters == []
    assert dsl.parse("limit:900", max_limit=100).limit == 100


CHUNKS = "chunk_id string, file_path string, content string, content_type string, depth short, embedding array<float>, file_mime_type string, language string, start_byte long, end_byte long, start_line int, end_line int"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("1", "/a/x.rs", "safe memory without collection", "code:rust", 0, [1.0, 0.0], "text/x-rust", "rust", 0, 5, 0, 1),
        ("2", "/a/y.py", "readable scripts and memory", "code:python", 1, [0.8, 0.6], "text/x-python", "python", 0, 5, 0, 1),
        ("3", "/b/z.md", "memory memory memory", "markdown", 2, [0.0, 1.0], "text/markdown", None, 0, 5, 0, 1),
        ("4", "/b/n.md", None, None, 0, None, None, None, 0, 5, 0, 1),
    ]
    return spark.createDataFrame(rows, CHUNKS)


def test_filters_come_before_the_limit(chunks):
    got = search.search(chunks, search.SearchRequest([1.0, 0.0], None, 1, [dsl.Filter("mime", "markdown")])).collect()
    assert [r.chunk_id for r in got] == ["3"]
    ids = lambda *f: {r.chunk_id for r in dsl.apply_filters(chunks, list(f)).collect()}
    assert ids(dsl.Filter("glob", "/a/*.py")) == {"2"} and ids(dsl.Filter("path", "/b")) == {"3", "4"} and ids(dsl.Filter("mime", "code")) == {"1", "2"}
    assert ids(dsl.Filter("max_depth", 1), dsl.Filter("min_depth", 1)) == {"2"} and ids(dsl.Filter("language", "rust")) == {"1"}
    with pytest.raises(ValueError):
        dsl.apply_filters(chunks, [dsl.Filter("after", "2020-01-01")])


def test_top_k_and_metrics(chunks):
    assert [r.chunk_id for r in search.top_k(chunks, [1.0, 0.0], 3).collect()] == ["1", "2", "3"]
    assert [r.chunk_id for r in search.top_k(chunks, [0.0, 1.0], 2, metric="l2").collect()] == ["3", "2"]
    assert search.top_k(chunks, [1.0, 0.0], 0).count() == 0


def bm25(texts, query):
    docs = {i: re.findall(r"\w+", t.lower()) for i, t in texts.items() if t and re.findall(r"\w+", t)}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for i, d in docs.items():
        for t in set(re.findall(r"\w+", query.lower())):
            tf, df = d.count(t), sum(t in x for x in docs.values())
            if tf:
                out[i] = out.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
    return out


def test_bm25_with_and_without_an_index(spark, tmp_path):
    texts = {1: "the cat sat", 2: "the dog sat on the mat", 3: "Größe cat cat", 4: None, 5: "", 6: "..."}
    df = spark.createDataFrame(list(texts.items()), "id int, t string")
    want = bm25(texts, "Cat sat größe")
    for index in (None, fulltext.StoredIndex.build(df, "id", "t", str(tmp_path / "i"), 3)):
        got = {r.id: r.bm25 for r in fulltext.bm25(df, "id", "t", "Cat sat größe", index).collect()}
        assert got == pytest.approx(want)
    assert fulltext.bm25(df, "id", "t", " . ").count() == 0
    assert index.documents == 3 and index.search(" . ").count() == 0 and index.search("zebra").count() == 0
    empty = fulltext.StoredIndex.build(df.limit(0), "id", "t", str(tmp_path / "e"))
    assert empty.documents == 0 and empty.search("cat").count() == 0
    assert fulltext.bm25(df.limit(0), "id", "t", "cat").count() == 0


def test_hybrid(chunks):
    got = search.hybrid(chunks.where("embedding is not null"), "memory", [1.0, 0.0], 3).collect()
    assert {r.chunk_id for r in got} == {"1", "2", "3"} and all(r.rrf_score <= 2 / 61 for r in got)
    by_text = search.search(chunks, search.SearchRequest(None, "memory", 2)).collect()
    assert [r.chunk_id for r in by_text][0] == "3" and len(by_text) == 2


def test_batch_equals_single(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 8))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(120)] + [(500, None), (501, [1.0]), (502, [0.0] * 8)], "id int, v array<float>")
    asked = df.where("id % 10 = 0 and id < 120").withColumnRenamed("id", "q")
    for block in (4096, 5):
        got = {}
        for r in search.batch_top_k(asked, df, 4, "q", "id", "v", 8, exclude_self=True, block=block).collect():
            got.setdefault(r.q, []).append((r["rank"], r.id))
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        for q in range(0, 120, 10):
            s = u @ u[q]
            s[q] = -9
            assert [i for _, i in sorted(got[q])] == np.argsort(-s)[:4].tolist()


def test_similar_files_and_documents(chunks):
    got = search.similar_files(chunks.where("embedding is not null"), "/a/x.rs", [1.0, 0.0], 5, distinct_files=True).collect()
    assert [r.file_path for r in got] == ["/a/y.py", "/b/z.md"]
    docs = search.as_documents(search.top_k(chunks, [1.0, 0.0], 1)).first()
    assert docs.page_content.startswith("safe") and docs.metadata["chunk_id"] == "1"
    assert '"query":"q"' in search.as_json(search.top_k(chunks, [1.0, 0.0], 2), "q").first().json


def test_embed_distinct(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, t string")
    got = {r.id: r.embedding for r in embedding.embed_distinct(df, "t", embedding.HashEmbedder(4)).collect()}
    assert got[1] == got[2] != got[3] and got[4] is None
    calls = spark.sparkContext.accumulator(0)

    def load():
        def model(texts):
            calls.add(len(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return model

    out = embedding.embed_distinct(df, "t", embedding.ModelEmbedder(load, 2, batch=1)).collect()
    assert calls.value == 2 and {r.id: r.embedding for r in out}[3] == [1.0, 1.0]
    pooled = embedding.mean_pool(np.array([[[3.0, 4.0], [9.0, 9.0]]]), np.array([[1, 0]]))
    assert pooled.tolist() == [[0.6, 0.8]]

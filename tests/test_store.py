import os
import time

import pytest

from gleaner import schema
from gleaner.__main__ import index_path
from gleaner.api import Corpus
from gleaner.config import Settings
from gleaner.operators import store as K
from gleaner.operators.embedding import HashEmbedder
from gleaner.operators.store import TableStore
from gleaner.streaming import indexer as I


def chunk(i, path, text, dim=4):
    return dict(chunk_id=i, file_path=path, content=text, content_type="text", chunk_index=0, start_byte=0, end_byte=len(text), depth=0, embedding=[0.5] * dim)


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, f"file://{tmp_path}/s", 4)


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, file_path string, content string, content_type string, chunk_index int, start_byte long, end_byte long, depth short, embedding array<float>")


def test_chunks(spark, store):
    assert store.read("chunks").count() == 0 and store.upsert_chunks(frame(spark, [])) == 0
    store.upsert_chunks(frame(spark, [chunk("1", "/a", "x"), chunk("2", "/a", "y"), chunk("3", "/b", "z")]))
    store.upsert_chunks(frame(spark, [chunk("1", "/a", "new"), chunk("1", "/a", "new")]))
    assert {r.chunk_id: r.content for r in store.read("chunks").collect()} == {"1": "new", "2": "y", "3": "z"}
    assert store.chunks_of("/a").count() == 2 and store.chunks_of("/none").count() == 0
    files = spark.createDataFrame([("f", "/a", 3, "indexed")], "file_id string, path string, size_bytes long, status string")
    store.upsert_files(files)
    store.upsert_files(files)
    assert store.read("files").count() == 1 and store.file("/a").first().size_bytes == 3
    assert store.rename("/a", "/c/d") == 2
    assert {r.file_path for r in store.read("chunks").collect()} == {"/c/d", "/b"} and store.file("/c/d").first().status == "indexed"
    assert all(r.embedding == [0.5] * 4 for r in store.read("chunks").collect())
    assert store.rename("/none", "/x") == 0 and store.delete("/c/d") == 2 and store.delete("/c/d") == 0
    s = store.stats().first()
    assert (s.chunks, s.files) == (1, 0) and s.bytes > 0
    assert store.vacuum() > 0 and store.read("chunks").count() == 1
    assert TableStore(spark, store.root).buckets == 4
    (r,) = K.list_indexes(spark, store.root.rsplit("/", 1)[0]).collect()
    assert r.name == "s" and r.bytes > 0 and r.modified_at is not None


def test_new_rows_are_appended_and_folders_joined(spark, store, monkeypatch):
    monkeypatch.setattr(K, "MAX_FOLDERS", 3)
    for i in range(6):
        store.upsert_chunks(frame(spark, [chunk(f"{i}", "/a", f"text {i}")]))
        folders = store._read_manifest()["chunks"]
        assert len(folders) == 1 and len(*folders.values()) == [1, 2, 3, 1, 2, 3][i]
    assert {r.chunk_id for r in store.read("chunks").collect()} == {str(i) for i in range(6)}
    assert {r.id for r in store.fulltext().search("4 text").collect()} == {str(i) for i in range(6)}
    before = store._read_manifest()["fulltext"]
    store.upsert_chunks(frame(spark, [chunk("2", "/a", "changed")]))
    assert store.fulltext().search("2").count() == 0 and store.fulltext().search("changed").count() == 1
    assert store._read_manifest()["fulltext"] != before
    store.rebucket(2)
    assert store.buckets == 2 and store.read("chunks").count() == 6 and store.chunks_of("/a").count() == 6
    assert store.fulltext().documents == 6


def test_buckets_from_the_first_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "BUCKET_ROWS", 1)
    monkeypatch.setattr(K, "MIN_BUCKETS", 2)
    s = TableStore(spark, f"file://{tmp_path}/auto")
    s.upsert_chunks(frame(spark, [chunk(str(i), f"/{i}", "x") for i in range(5)]))
    assert s.buckets == 5 == TableStore(spark, s.root).buckets and s.read("chunks").count() == 5


def test_a_reader_keeps_its_state(spark, store):
    store.upsert_chunks(frame(spark, [chunk("1", "/a", "x")]))
    before = store.read("chunks")
    store.upsert_chunks(frame(spark, [chunk("1", "/a", "y")]))
    assert before.first().content == "x" and store.read("chunks").first().content == "y"


def test_table_functions(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, t int, v string")
    assert {(r.k, r.v) for r in K.latest(df, "k", "t").collect()} == {("a", "y"), ("b", None)}
    v = spark.createDataFrame([([1.0, 2.0],), (None,)], "embedding array<float>")
    assert [r.embedding for r in K.with_vectors(v, 2).collect()] == [[1.0, 2.0], [0.0, 0.0]]
    with pytest.raises(Exception, match="entries"):
        K.with_vectors(v, 3).collect()
    from pyspark.sql import functions as F

    s = spark.createDataFrame([("indexed",), ("odd",), (None,)], "s string")
    assert [r.x for r in s.select(K.normalized_status(F.col("s")).alias("x")).collect()] == ["indexed", "pending", "pending"]
    t = spark.createDataFrame([("pdf_page:3",), ("",), (None,), ("code:x",)], "s string")
    assert [r.x for r in t.select(K.normalized_content_type(F.col("s")).alias("x")).collect()] == ["pdf:3", "text", "text", "code:x"]


def write(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb" if isinstance(text, bytes) else "w") as f:
        f.write(text)
    return path


@pytest.fixture
def corpus(spark, tmp_path):
    settings = Settings()
    settings.embedding.dim, settings.index.buckets = 16, 2
    return Corpus(spark, f"file://{tmp_path}/index", settings)


def test_sync_follows_a_folder(spark, corpus, tmp_path, monkeypatch):
    root = f"{tmp_path}/docs"
    for n, t in (("ml.txt", "Networks learn from data."), ("db.md", "# Tables\n\nRows and columns."), ("src/a.py", "def f():\n    return 1\n"), (".git/x", "no"), ("bad.txt", b"\xff\xfe\x00"), ("p.pdf", b"%PDF"), ("i.png", b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR\x00\x00\x00\x02\x00\x00\x00\x03")):
        write(root, n, t)
    kinds = lambda df: sorted((r.kind, r.path[len(root) + 1 :], r.to_path and r.to_path[len(root) + 1 :]) for r in df.collect())
    assert kinds(corpus.index(root)) == [("created", n, None) for n in ("bad.txt", "db.md", "i.png", "ml.txt", "p.pdf", "src/a.py")]
    state = {r.path[len(root) + 1 :]: (r.status, r.chunk_count) for r in corpus.files.collect()}
    assert state == {"bad.txt": ("error", 0), "db.md": ("indexed", 1), "i.png": ("indexed", 1), "ml.txt": ("indexed", 1), "p.pdf": ("error", 0), "src/a.py": ("indexed", 1)}
    assert any(r.content == "Image: i.png (2x3, png)" for r in corpus.chunks.collect())
    assert [r[1] for r in kinds(corpus.index(root))] == ["bad.txt", "p.pdf"]  # errors are tried again
    write(root, "ml.txt", "Networks learn from more data.")
    os.remove(f"{root}/db.md")
    os.rename(f"{root}/src/a.py", f"{root}/src/b.py")
    got = [x for x in kinds(corpus.index(root)) if x[1] not in ("bad.txt", "p.pdf")]
    assert got == [("deleted", "db.md", None), ("modified", "ml.txt", None), ("renamed", "src/a.py", "src/b.py")]
    assert {r.file_path[len(root) + 1 :] for r in corpus.chunks.collect()} == {"ml.txt", "src/b.py", "i.png"}
    assert corpus.query("more data limit:1").first().content == "Networks learn from more data."
    assert corpus.query("return lang:python").count() >= 1 and corpus.documents("data", 2).count() == 2
    n = corpus.chunks.count()
    corpus.index(root, force=True)
    assert corpus.chunks.count() == n
    monkeypatch.setattr(I, "MAX_LISTED", 2)  # by folder
    write(root, "ml.txt", "Now something else.")
    write(root, "src/deep/er.txt", "Deep.")
    os.remove(f"{root}/i.png")
    changes = corpus.index(root)
    got = {x[:2] for x in kinds(changes)}
    assert {("modified", "ml.txt"), ("created", "src/deep/er.txt"), ("deleted", "i.png")} <= got
    assert {r.content for r in corpus.chunks.collect()} >= {"Now something else.", "Deep."}
    feed = {(r.event, r.path[len(root) + 1 :]) for r in corpus.indexer().updates(root, changes).collect()}
    assert feed >= {("started", ""), ("indexed", "ml.txt"), ("indexed", "src/deep/er.txt"), ("removed", "i.png"), ("error", "bad.txt")}
    monkeypatch.setattr(I, "MAX_LISTED", 1)  # the whole tree
    write(root, "src/b.py", "def g():\n    return 2\n")
    assert ("modified", "src/b.py") in {x[:2] for x in kinds(corpus.index(root))}


def test_watch_once(spark, corpus, tmp_path):
    root = f"{tmp_path}/w"
    write(root, "a.txt", "first text")
    seen = []
    q = corpus.indexer().watch(root, f"{tmp_path}/cp", once=False, interval="200 milliseconds", on_change=lambda df, e: seen.append(df.count()))
    until = time.time() + 60
    while not seen and time.time() < until:
        time.sleep(0.2)
    q.stop()
    assert seen and corpus.chunks.count() == 1


def test_add_texts_and_plans(spark, corpus):
    df = spark.createDataFrame([("/t/a.txt", "alpha beta"), ("/t/b.txt", "alpha beta"), ("/t/c.md", "gamma"), (None, "x"), ("/t/d", None)], "path string, text string")
    assert corpus.add_texts(df) == 3 and corpus.add_texts(df) == 3 and corpus.chunks.count() == 3
    assert [(r.representative, r.duplicate) for r in corpus.duplicates().collect()] == [("/t/a.txt", "/t/b.txt")]
    assert {r.path for r in corpus.duplicates(mode="components").collect()} == {"/t/a.txt", "/t/b.txt"}
    assert corpus.propose("/t", "cleanup").first().source == "/t/b.txt"
    assert corpus.propose("/t", "by_topic", 2).where("action = 'move'").count() == 3
    assert corpus.propose("/t", "by_category", categories=["one", "two"]).where("action = 'mkdir'").count() == 2
    assert corpus.similar_files("/t/a.txt", 1).first().file_path == "/t/b.txt" and corpus.similar_files("/none", 1).count() == 0
    with pytest.raises(ValueError):
        corpus.propose("/t", "odd")


def test_diff(spark, monkeypatch):
    files = spark.createDataFrame([("/a", "1", "indexed"), ("/b", "2", "indexed"), ("/c", "3", "error"), ("/d", "4", "indexed"), ("/e", "5", "deleted"), (None, "9", "indexed")], "path string, content_hash string, status string")
    snap = spark.createDataFrame([("/a", "1"), ("/b", "x"), ("/c", "3"), ("/d2", "4"), ("/d3", "4"), ("/new", None), (None, "7")], "path string, content_hash string")
    got = {(r.kind, r.path, r.to_path) for r in I.diff(snap, files).collect()}
    want = {("modified", "/b", None), ("modified", "/c", None), ("renamed", "/d", "/d2"), ("created", "/d3", None), ("created", "/new", None)}
    assert got == want
    monkeypatch.setattr(I, "HOT_HASH", 0)  # the way for hashes that very many paths share
    assert {(r.kind, r.path, r.to_path) for r in I.diff(snap, files).collect()} == want


def test_events(spark):
    raw = spark.createDataFrame([("create", ["/a"]), ("modify", ["/a/.h"]), ("other", ["/a", "/b"]), ("remove", ["/c"]), ("odd", ["/x"])], "op string, paths array<string>").selectExpr("*", "timestamp'2026-01-01' ts")
    assert {(r.kind, r.path, r.to_path) for r in I.to_events(raw).collect()} == {("created", "/a", None), ("renamed", "/a", "/b"), ("deleted", "/c", None)}


def test_streamed_feed_equals_batch(spark, tmp_path):
    kinds = "feed_id long, kind string, path string, to_path string, seen_at timestamp, arrived_at timestamp, origin string"
    from datetime import datetime, timedelta

    t = datetime(2026, 1, 1)
    rows = [(i, ["created", "modified", "deleted"][i % 3], f"/p{i % 4}", None, t + timedelta(minutes=i), t, None) for i in range(40)]
    spark.createDataFrame(rows, kinds).repartition(3).write.parquet(f"{tmp_path}/feed")
    got = {}
    q = I.consume_feed(spark, f"{tmp_path}/feed", f"{tmp_path}/cp", lambda df, e: got.update({r.path: r.feed_id for r in df.collect()}))
    q.awaitTermination()
    assert got == {f"/p{k}": max(i for i in range(40) if i % 4 == k) for k in range(4)}


def test_config(tmp_path):
    with open(f"{tmp_path}/c.toml", "w") as f:
        f.write("[chunking]\ntarget_size = 100\n[query]\nhybrid = false\n")
    s = Settings.load(f"{tmp_path}/c.toml")
    assert s.chunk_config().target == 100 and s.query.hybrid is False
    with open(f"{tmp_path}/d.toml", "w") as f:
        f.write(s.dump())
    assert Settings.load(f"{tmp_path}/d.toml") == s
    with open(f"{tmp_path}/c.toml", "w") as f:
        f.write("[query]\nodd = 1\n")
    with pytest.raises(ValueError):
        Settings.load(f"{tmp_path}/c.toml")
    assert len(index_path("/x", "/h")) == 3 + 16


def test_schema_matches_the_layout(spark):
    assert len(spark.createDataFrame([], schema.CHUNKS).columns) == 20 and len(spark.createDataFrame([], schema.FILES).columns) == 10
    assert HashEmbedder(3).dim == 3

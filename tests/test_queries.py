"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, float):
        return round(x, 5)
    if isinstance(x, pd.Timestamp):
        return str(x.tz_convert(None) if x.tz else x)
    return x


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(str(tuple(plain(v) for v in r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def spans(rows, key):
    """Rows per document in order of chunk, whose indexes run from 0 and whose ranges are not empty and do not go back."""
    by = {}
    for r in rows:
        by.setdefault(r[key], []).append(r)
    for group in by.values():
        group.sort(key=lambda r: r.chunk_index)
        assert [r.chunk_index for r in group] == list(range(len(group)))
        assert all(r.start_byte < r.end_byte for r in group) and all(x.start_byte <= y.start_byte for x, y in zip(group, group[1:], strict=False))
    return by


def test_semantic_chunks(spark):
    by = spans(entry.queries()["semantic_chunks"](spark, DATA).collect(), "doc_id")
    texts = spark.read.parquet(f"{DATA}/documents.parquet").where("trim(text) <> ''").select("doc_id", "text").collect()
    assert set(by) == {r.doc_id for r in texts if r.text.strip()}
    sizes = {r.doc_id: len(r.text.encode()) for r in texts}
    assert all(group[0].start_byte < sizes[i] for i, group in by.items())


def test_code_chunks(spark):
    from gleaner.functions.paths import CODE_LANGUAGES
    from gleaner.operators.chunking import code_boundary

    by = spans(entry.queries()["code_chunks"](spark, DATA).collect(), "chunk_id")
    source = {r.chunk_id: r for r in spark.read.parquet(f"{DATA}/chunks.parquet").where("content_type LIKE 'code:%'").select("chunk_id", "content", "content_type").collect()}
    assert by and set(by) <= set(source)
    for i, group in by.items():
        data, tag = source[i].content.encode(), source[i].content_type[5:].lower()
        for r in group:
            assert r.end_byte <= len(data) + 1 and (r.start_byte == 0 or data[r.start_byte - 1 : r.start_byte] == b"\n")
        opened = [r for k, r in enumerate(group) if r.symbol_type and (k == 0 or (group[k - 1].symbol_type, group[k - 1].symbol_name) != (r.symbol_type, r.symbol_name))]
        for r in opened:
            first = data[r.start_byte :].split(b"\n", 1)[0].decode().removesuffix("\r")
            assert code_boundary(first, CODE_LANGUAGES.get(tag, tag)) == (r.symbol_type, r.symbol_name)


def test_split_documents(spark):
    rows = entry.queries()["split_documents"](spark, DATA).collect()
    assert len(rows) == entry.queries()["semantic_chunks"](spark, DATA).count()
    assert all(r.page_content and {"source", "content_type", "chunk_index", "start_byte", "end_byte"} <= set(r.metadata) for r in rows)


def test_query_string_json(spark):
    import json

    (row,) = entry.queries()["query_string_json"](spark, DATA).collect()
    got = json.loads(row.json)
    assert got["query"] == "snapshot of the archive" and 0 < len(got["results"]) <= 5
    scores = [r["score"] for r in got["results"]]
    assert scores == sorted(scores, reverse=True) and all(len(r["content"]) <= 503 for r in got["results"])
    kinds = {r.file_path for r in spark.read.parquet(f"{DATA}/chunks.parquet").where("content_type = 'markdown' OR file_mime_type LIKE '%markdown%'").collect()}
    assert {r["file"] for r in got["results"]} <= kinds


def test_retriever_documents(spark):
    rows = entry.queries()["retriever_documents"](spark, DATA).collect()
    assert len(rows) == 4 and all(r.page_content and {"chunk_id", "file_path", "score"} <= set(r.metadata) for r in rows)


def test_every_query_is_tested():
    here = {n.removeprefix("test_") for n in globals() if n.startswith("test_")}
    assert {n for n in entry.queries() if n not in entry.oracle_sql() and not (n[0] == "p" and n[1].isdigit())} <= here


def test_entry(spark):
    assert entry.entry(spark).count() == 10

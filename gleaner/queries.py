"""Registered queries of the core operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import paths as P
from gleaner.functions import text as T
from gleaner.functions import vectors as V
from gleaner.operators import analytics as A
from gleaner.operators import chunking as C
from gleaner.operators import embedding as E
from gleaner.operators import fileops as O
from gleaner.operators import fulltext as X
from gleaner.operators import search as S
from gleaner.operators import store as K
from gleaner.plans import dsl, organize
from gleaner.runtime import materialize, shared_dir, table
from gleaner.sources import files as SRC
from gleaner.sources import logs as L
from gleaner.streaming import indexer as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIM = 64
NOW = "2026-06-01 00:00:00"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# ---------------------------------------------------------------- SQL parts

_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


def _dot(a: str, b: str) -> str:
    return _DOT.format(a=a, b=b)


def _cos(a: str, b: str) -> str:
    return f"coalesce({_dot(a, b)} / nullif(sqrt({_dot(a, a)}) * sqrt({_dot(b, b)}), 0), 0)"


_LATEST_FILES = "latest AS (SELECT path, max(size_bytes) AS size_bytes, max(mime_type) AS mime_type FROM files WHERE path IS NOT NULL GROUP BY path)"
_UNIQUE_CHUNKS = "c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks ORDER BY chunk_id, indexed_at DESC)"
_EXT = "lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '.\\.([^.]+)$', 1))"


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Chunks with one row per id, the latest; only the columns asked for are read and moved."""
    rows = table(spark, d, "chunks")
    return K.latest(rows.select("chunk_id", *columns, "indexed_at") if columns else rows, "chunk_id", "indexed_at")


_stored: dict[tuple[str, str], X.StoredIndex] = {}


def _index(spark: SparkSession, d: str) -> X.StoredIndex:
    """The stored full-text index of the documents; written when a session first asks for it."""
    key = spark.sparkContext.applicationId, d
    if key not in _stored:
        _stored[key] = X.StoredIndex.build(table(spark, d, "documents"), "doc_id", "text", f"{shared_dir(spark)}/fulltext-{uuid.uuid4().hex}")
    return _stored[key]


def _vector(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


# ---------------------------------------------------------------- vector search


def _topk(metric: str, label: int | None = None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, "embeddings")
        if label is not None:
            rows = rows.where(F.col("label") == label)
        return S.top_k(rows, _vector(spark, d, 0), 10, "embedding", "vec_id", metric).select("vec_id", F.round("score", 6).alias("score"))

    return run


def _topk_sql(score: str, where: str = "true") -> str:
    return f"""WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, {score} AS score FROM embeddings, q WHERE {where})
        SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10"""


_L2 = "1 - list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::DOUBLE - qv[i]::DOUBLE) * (embedding[i]::DOUBLE - qv[i]::DOUBLE)))"
for _name, _metric, _label, _sql in (
    ("vector_topk_cosine", "cosine", None, _topk_sql(_cos("embedding", "qv"))),
    ("vector_topk_l2", "l2", None, _topk_sql(_L2)),
    ("vector_topk_dot", "dot", None, _topk_sql(_dot("embedding", "qv"))),
    ("vector_topk_filtered", "cosine", 3, _topk_sql(_cos("embedding", "qv"), "label = 3")),
):
    QUERIES[_name], ORACLES[_name] = _topk(_metric, _label), _sql


@query(
    f"""WITH s AS (SELECT q.vec_id AS query_id, r.vec_id, round({_cos("q.embedding", "r.embedding")}, 9) AS score
          FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, vec_id, round(score, 6) AS score, rank::INT AS rank FROM k WHERE rank <= 5"""
)
def batch_topk_per_query(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest of every row for the queries whose id is divisible by 100."""
    rows = table(spark, d, "embeddings")
    asked = rows.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    found = S.batch_top_k(asked, rows, 5, "query_id", "vec_id", "embedding", DIM, exclude_self=True)
    return found.withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_UNIQUE_CHUNKS}, q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 1),
        s AS (SELECT chunk_id, file_path, {_cos("embedding", "qv")} AS score FROM c, q
              WHERE language = 'rs' AND starts_with(file_path, '/corpus/') AND regexp_matches(file_path, '^/corpus/[^/]*/src/.*$') AND depth <= 2)
        SELECT chunk_id, file_path, round(score, 6) AS score FROM s ORDER BY s.score DESC, chunk_id LIMIT 15"""
)
def dsl_filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """A query string whose filters apply before the best are chosen."""
    q = dsl.parse("lang:rs path:/corpus/ path:/corpus/*/src/** depth:2 limit:15")
    rows = _chunks(spark, d, "file_path", "language", "depth", "embedding")
    found = S.search(rows, S.SearchRequest(_vector(spark, d, 1), q.text, q.limit, q.filters))
    return found.select("chunk_id", "file_path", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_UNIQUE_CHUNKS}, m AS (SELECT path, max(modified_at) AS modified_at FROM files GROUP BY path), q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 2),
        s AS (SELECT chunk_id, {_cos("embedding", "qv")} AS score FROM c JOIN m ON file_path = path, q
              WHERE m.modified_at > TIMESTAMPTZ '2026-01-01 00:00:00+00' AND (file_mime_type = 'markdown' OR content_type = 'markdown' OR starts_with(content_type, 'markdown:')))
        SELECT chunk_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, chunk_id LIMIT 12"""
)
def search_modified_after(spark: SparkSession, d: str) -> DataFrame:
    """Filters on modification time and type."""
    filters = [dsl.Filter("after", "2026-01-01 00:00:00"), dsl.Filter("mime", "markdown")]
    rows = _chunks(spark, d, "file_path", "file_mime_type", "content_type", "embedding")
    found = S.search(rows, S.SearchRequest(_vector(spark, d, 2), None, 12, filters), table(spark, d, "files"))
    return found.select("chunk_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_UNIQUE_CHUNKS}, q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 3),
        s AS (SELECT file_path, chunk_id, {_cos("embedding", "qv")} AS score FROM c, q),
        b AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, chunk_id DESC) AS r FROM s)
        SELECT file_path, chunk_id, round(score, 6) AS score FROM b WHERE r = 1 ORDER BY b.score DESC, chunk_id LIMIT 10"""
)
def similar_files(spark: SparkSession, d: str) -> DataFrame:
    """The best chunk of each of the ten files nearest to a vector."""
    found = S.similar_files(_chunks(spark, d), "", _vector(spark, d, 3), 10, distinct_files=True)
    return found.select("file_path", "chunk_id", F.round("score", 6).alias("score"))


_WORDS = "archive retention snapshot"
_TOKENS = "tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents WHERE text IS NOT NULL), d AS (SELECT doc_id, t, len(t) AS dl FROM tok WHERE len(t) > 0)"
_BM25 = f"""{_TOKENS}, n AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM d),
    tf AS (SELECT doc_id, dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM d, (SELECT unnest(string_split('{_WORDS}', ' ')) AS term)),
    df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term),
    bm AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM tf JOIN df USING (term), n WHERE tf > 0 GROUP BY doc_id)"""


@query(f"WITH {_TOKENS} SELECT count(*) AS documents, sum(dl)::BIGINT AS words FROM d")
def fulltext_index(spark: SparkSession, d: str) -> DataFrame:
    """The stored full-text index of the documents, built when a session first asks for it, and what it covers."""
    built = _index(spark, d)
    return spark.createDataFrame([(built.documents, built.words)], "documents long, words long")


@query(f"WITH {_BM25} SELECT doc_id, round(bm25, 6) AS bm25 FROM bm ORDER BY bm.bm25 DESC, doc_id LIMIT 20")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best of BM25 over the stored index, whose postings of the query's terms are all that is read."""
    found = _index(spark, d).search(_WORDS)
    return found.orderBy(F.desc("bm25"), "id").limit(20).select(F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


@query(f"WITH {_TOKENS}, u AS (SELECT doc_id, dl, unnest(t) AS term FROM d) SELECT term, doc_id, count(*) AS tf, any_value(dl)::INT AS dl FROM u GROUP BY term, doc_id")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return X.inverted_index(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


_HASHED = """list_transform(range(0, 32), lambda i: ((('0x' || substr(sha256({t}), 2 * i + 1, 2))::INT) / 255.0::DOUBLE - 0.5)::FLOAT)"""


@query(
    f"""WITH {_BM25}, v AS (SELECT doc_id, {_HASHED.format(t="text")} AS v FROM documents WHERE text IS NOT NULL), q AS (SELECT {_HASHED.format(t=f"'{_WORDS}'")} AS qv),
        cs AS (SELECT doc_id, {_cos("v", "qv")} AS vector_score FROM v, q),
        a AS (SELECT doc_id, vector_score, row_number() OVER (ORDER BY vector_score DESC, doc_id) AS ra FROM cs), b AS (SELECT doc_id, bm25, row_number() OVER (ORDER BY bm25 DESC, doc_id) AS rb FROM bm),
        f AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, vector_score, bm25, coalesce(1.0::DOUBLE / (60 + ra), 0) + coalesce(1.0::DOUBLE / (60 + rb), 0) AS rrf_score
              FROM (SELECT * FROM a WHERE ra <= 50) a FULL JOIN (SELECT * FROM b WHERE rb <= 50) b ON a.doc_id = b.doc_id)
        SELECT doc_id, round(vector_score, 6) AS vector_score, round(bm25, 6) AS bm25, round(rrf_score, 8) AS rrf_score FROM f ORDER BY f.rrf_score DESC, doc_id LIMIT 10"""
)
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Vector and full-text lists fused by reciprocal rank."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text").withColumn("v", V.hash_embed("text", 32))
    vector = list(spark.range(1).select(V.hash_embed(F.lit(_WORDS), 32).alias("v")).first().v)
    found = S.hybrid(docs, _WORDS, vector, 10, 50, "text", "v", "doc_id", index=_index(spark, d))
    return found.select("doc_id", F.round("vector_score", 6).alias("vector_score"), F.round("bm25", 6).alias("bm25"), F.round("rrf_score", 8).alias("rrf_score"))


@query()
def query_string_json(spark: SparkSession, d: str) -> DataFrame:
    """A whole query: parsed, embedded, searched both ways, and given as JSON."""
    found = S.run_query(_chunks(spark, d), "snapshot of the archive type:markdown limit:5", E.HashEmbedder(DIM))
    return S.as_json(found, "snapshot of the archive")


@query()
def retriever_documents(spark: SparkSession, d: str) -> DataFrame:
    """Results as documents with their metadata."""
    return S.as_documents(S.run_query(_chunks(spark, d), "retention limit:4", E.HashEmbedder(DIM)))


# ---------------------------------------------------------------- vectors


@query(
    f"""WITH n AS (SELECT vec_id, embedding AS v, sqrt({_dot("embedding", "embedding")}) AS n FROM embeddings)
        SELECT vec_id, round(v[1]::DOUBLE / greatest(n, 1e-12), 6) AS first, round(v[64]::DOUBLE / greatest(n, 1e-12), 6) AS last,
               round(list_sum(list_transform(v, lambda x: x::DOUBLE / greatest(n, 1e-12))), 6) AS total FROM n"""
)
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", V.l2_normalize("embedding").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"), F.round(total, 6).alias("total"))


@query(
    f"""WITH v AS (SELECT doc_id, {_HASHED.format(t="text")} AS v FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, round(v[1]::DOUBLE, 6) AS first, round(v[32]::DOUBLE, 6) AS last, round(list_sum(list_transform(v, lambda x: x::DOUBLE)), 5) AS total FROM v"""
)
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct text embedded once."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    rows = E.embed_distinct(docs, "text", E.HashEmbedder(32), "v")
    total = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return rows.select("doc_id", F.round(F.col("v")[0].cast("double"), 6).alias("first"), F.round(F.col("v")[31].cast("double"), 6).alias("last"), F.round(total, 5).alias("total"))


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select(SRC.content_hash(F.col("text")).alias("content_hash"), "doc_id")
    return docs.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


# ---------------------------------------------------------------- chunking

_FIXED = """WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL AND length(text) > 0),
    w AS (SELECT doc_id, text, n, unnest(range(0, n, 1792)) AS s FROM t),
    e AS (SELECT *, least(s + 2048, n) AS te FROM w),
    r AS (SELECT *, te - ((te - s) // 5) AS lo, least(te + ((te - s) // 10), n) AS hi FROM e),
    x AS (SELECT *, substring(text, lo + 1, hi - lo + 1) AS wide, substring(text, lo + 1, hi - lo) AS narrow FROM r),
    p AS (SELECT *, strpos(reverse(wide), chr(10) || chr(10)) AS b, strpos(reverse(narrow), chr(10)) AS l,
            strpos(regexp_replace(reverse(wide), '[\\s][.!?]', chr(1) || chr(1)), chr(1)) AS st FROM x),
    c AS (SELECT doc_id, text, n, s, CASE WHEN te >= n THEN n WHEN b > 0 THEN lo + length(wide) - b + 1 WHEN l > 0 THEN lo + length(narrow) - l + 1
            WHEN st > 0 THEN lo + length(wide) - st ELSE te END AS e FROM p),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS k, min(CASE WHEN e >= n THEN s END) OVER (PARTITION BY doc_id) AS final FROM c),
    g AS (SELECT doc_id, k, substring(text, 1, s) AS head, substring(text, s + 1, e - s) AS content FROM f WHERE s <= final)"""


@query(
    f"""{_FIXED} SELECT doc_id, k::INT AS chunk_index, strlen(head)::BIGINT AS start_byte, (strlen(head) + strlen(content))::BIGINT AS end_byte,
        (length(head) - length(replace(head, chr(10), '')))::INT AS start_line,
        (length(head) - length(replace(head, chr(10), '')) + length(content) - length(replace(content, chr(10), '')))::INT AS end_line, md5(content) AS digest FROM g"""
)
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 512 tokens with 64 overlapping over all documents."""
    out = C.fixed_chunks(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "chunk_index", "start_byte", "end_byte", "start_line", "end_line", F.md5("content").alias("digest"))


@query(f"{_FIXED} SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents, max(strlen(content))::BIGINT AS longest, sum(strlen(content))::BIGINT AS bytes FROM g")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    out = C.fixed_chunks(table(spark, d, "documents").select("doc_id", "text"))
    size = F.octet_length("content").cast("long")
    return out.agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"), F.max(size).alias("longest"), F.sum(size).alias("bytes"))


@query()
def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents by their headings and paragraphs."""
    return C.chunk_documents(table(spark, d, "documents").select("doc_id", "text"), strategy="semantic").drop("content")


@query()
def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Code by its symbols."""
    code = _chunks(spark, d, "content_type", "content").where(F.col("content_type").startswith("code:")).select("chunk_id", "content_type", F.col("content").alias("text"))
    return C.chunk_documents(code).select("chunk_id", F.col("chunk_index"), "symbol_type", "symbol_name", "start_byte", "end_byte")


@query()
def split_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with metadata as documents per chunk."""
    docs = table(spark, d, "documents").select(F.col("text").alias("page_content"), F.create_map(F.lit("source"), F.col("source"), F.lit("content_type"), F.lit("markdown")).alias("metadata"))
    return C.split_documents(docs)


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
       SELECT doc_id, length(regexp_extract(line, '^\\s*(#{1,6})\\s', 1))::INT AS level, count(*) AS headings FROM l WHERE regexp_extract(line, '^\\s*(#{1,6})\\s', 1) <> '' GROUP BY 1, 2"""
)
def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    """Headings per document and level."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", T.heading_level(F.col("line")).cast("int").alias("level")).where("level is not null").groupBy("doc_id", "level").agg(F.count("*").alias("headings"))


@query(
    """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS part FROM documents WHERE text IS NOT NULL)
       SELECT doc_id, count(*) AS paragraphs, sum(strlen(part))::BIGINT AS bytes FROM p WHERE trim(part, ' ') <> '' GROUP BY doc_id"""
)
def paragraph_elements(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs as extracted elements."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(T.paragraphs(F.col("text"))).alias("p"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.octet_length("p.text").cast("long")).alias("bytes"))


@query(
    f"""WITH {_UNIQUE_CHUNKS} SELECT chunk_id, lag(chunk_id) OVER w AS previous_id, lead(chunk_id) OVER w AS next_id FROM c
        WINDOW w AS (PARTITION BY file_path ORDER BY chunk_index, chunk_id)"""
)
def linked_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk with the one before and after it."""
    return C.linked(_chunks(spark, d, "file_path", "chunk_index")).select("chunk_id", "previous_id", "next_id")


@query(
    f"""WITH {_UNIQUE_CHUNKS}, s AS (SELECT chunk_id, replace(content, chr(10), ' ') AS flat, content FROM c)
        SELECT chunk_id, CASE WHEN length(flat) > 100 THEN substring(flat, 1, 97) || '...' ELSE flat END AS snippet,
               CASE WHEN length(content) > 200 THEN substring(content, 1, 200) || '...' ELSE content END AS preview FROM s"""
)
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, "content").select("chunk_id", T.snippet(F.col("content"), 100).alias("snippet"), T.preview(F.col("content"), 200).alias("preview"))


# ---------------------------------------------------------------- paths


def _case(column: str, pairs: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE {other} END"


@query(
    f"""WITH p AS (SELECT DISTINCT path FROM files WHERE path IS NOT NULL), e AS (SELECT path, {_EXT} AS ext FROM p), l AS (SELECT *, {_case("ext", P.CODE_LANGUAGES, "NULL")} AS lang FROM e)
        SELECT path, {_case("ext", P.MIME_BY_EXTENSION, "'text/plain'")} AS mime_type,
               CASE WHEN lang IS NOT NULL THEN 'code:' || lang WHEN ext IN ('md', 'markdown') THEN 'markdown' WHEN ext <> '' THEN 'code:' || ext ELSE 'text' END AS content_type FROM l"""
)
def path_types(spark: SparkSession, d: str) -> DataFrame:
    """MIME and content type of every path."""
    rows = table(spark, d, "files").where("path is not null").select("path").distinct()
    return rows.select("path", P.mime_of(F.col("path")).alias("mime_type"), P.content_type_of(F.col("path")).alias("content_type"))


@query(
    """SELECT DISTINCT path FROM files WHERE path IS NOT NULL
       AND NOT (regexp_matches(path, '/node_modules/') OR regexp_matches(path, '/target/') OR regexp_matches(path, '[.]lock$') OR regexp_matches(path, '(^|/)[.][^/]*$'))"""
)
def excluded_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths that the default exclusions leave."""
    rows = table(spark, d, "files").where("path is not null").select("path").distinct()
    return rows.where(~P.matches_any(F.col("path"), SRC.DEFAULT_EXCLUDES))


# ---------------------------------------------------------------- analytics

_CENTROIDS = f"""{_UNIQUE_CHUNKS}, u AS (SELECT file_path AS path, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM c),
    m AS (SELECT path, i, avg(x) AS x FROM u GROUP BY path, i), n AS (SELECT path, list(x ORDER BY i) AS v, sqrt(sum(x * x)) AS n FROM m GROUP BY path),
    cen AS (SELECT path, CASE WHEN n > 0 THEN list_transform(v, lambda x: x / n) ELSE v END AS centroid FROM n)"""


@query(f"WITH {_CENTROIDS} SELECT path, round(centroid[1], 6) AS first, round(centroid[64], 6) AS last, round(list_sum(centroid), 5) AS total FROM cen")
def file_centroids(spark: SparkSession, d: str) -> DataFrame:
    rows = A.file_centroids(_chunks(spark, d, "file_path", "embedding"))
    total = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x)
    return rows.select("path", F.round(F.col("centroid")[0], 6).alias("first"), F.round(F.col("centroid")[63], 6).alias("last"), F.round(total, 5).alias("total"))


_PAIRS = f"""{_CENTROIDS}, k AS (SELECT path, centroid, min(path) OVER (PARTITION BY list_transform(centroid, lambda x: round(x, 6))) AS class FROM cen WHERE list_sum(list_transform(centroid, lambda x: x * x)) > 0),
    r AS (SELECT path, centroid FROM k WHERE path = class),
    pr AS (SELECT a.path AS a, b.path AS b, {_dot("a.centroid", "b.centroid")} AS cosine FROM r a JOIN r b ON a.path < b.path WHERE {_dot("a.centroid", "b.centroid")} >= 0.95)"""


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pairs, members = A.duplicate_pairs(A.file_centroids(_chunks(spark, d, "file_path", "embedding")), 0.95)
    return materialize(pairs, "q-pairs"), members


@query(f"WITH {_PAIRS} SELECT a, b, round(cosine, 5) AS cosine FROM pr")
def near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Files with nearly the same mean vector, one file for each that have the very same."""
    return _pairs(spark, d)[0].select("a", "b", F.round("cosine", 5).alias("cosine"))


@query(f"WITH {_PAIRS} SELECT path, class FROM k")
def same_vector_classes(spark: SparkSession, d: str) -> DataFrame:
    """Membership of files in classes of the same mean vector."""
    return _pairs(spark, d)[1].select(F.col("id").alias("path"), "class")


@query(
    f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr UNION SELECT path, class FROM k WHERE path <> class UNION SELECT class, path FROM k WHERE path <> class),
        reach AS (SELECT a AS path, a AS root FROM e UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.path)
        SELECT path, min(root) AS group_path FROM reach GROUP BY path"""
)
def duplicate_components(spark: SparkSession, d: str) -> DataFrame:
    """Files joined by near-duplicate pairs directly or through others."""
    return A.duplicate_components(*_pairs(spark, d))


_GREEDY = f"""{_CENTROIDS}, k AS (SELECT path, centroid FROM cen WHERE list_sum(list_transform(centroid, lambda x: x * x)) > 0),
    pr AS (SELECT a.path AS a, b.path AS b, {_dot("a.centroid", "b.centroid")} AS cosine FROM k a JOIN k b ON a.path < b.path WHERE {_dot("a.centroid", "b.centroid")} >= 0.95),
    o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY a, b) AS i FROM pr),
    st AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS used, false AS taken
      UNION ALL SELECT o.i, CASE WHEN list_contains(used, a) OR list_contains(used, b) THEN used ELSE list_concat(used, [a, b]) END, NOT (list_contains(used, a) OR list_contains(used, b)) FROM st JOIN o ON o.i = st.i + 1),
    sz AS (SELECT path, max(size_bytes) AS size FROM files GROUP BY path),
    gr AS (SELECT a, b, cosine, coalesce(x.size, 0) AS sa, coalesce(y.size, 0) AS sb FROM o JOIN st USING (i) LEFT JOIN sz x ON x.path = a LEFT JOIN sz y ON y.path = b WHERE taken),
    dup AS (SELECT CASE WHEN sb > sa THEN b ELSE a END AS representative, CASE WHEN sb > sa THEN a ELSE b END AS duplicate, round(cosine, 5) AS cosine, least(sa, sb)::BIGINT AS wasted FROM gr)"""


@query(f"WITH RECURSIVE {_GREEDY} SELECT * FROM dup")
def duplicate_groups_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Representative and duplicate, each file used once."""
    sizes = table(spark, d, "files").select("path", F.col("size_bytes").alias("size"))
    pairs, members = _pairs(spark, d)
    return A.greedy_groups(pairs, sizes, members).withColumn("cosine", F.round("cosine", 5))


@query(f'WITH RECURSIVE {_GREEDY} SELECT count(DISTINCT representative) AS "groups", count(*) AS duplicates, coalesce(sum(wasted), 0)::BIGINT AS wasted FROM dup')
def duplicate_totals(spark: SparkSession, d: str) -> DataFrame:
    return A.duplicate_totals(duplicate_groups_greedy(spark, d))


_CLEANUP = f"""l AS (SELECT path, max(struct_pack(m := modified_at, s := size_bytes)) AS f FROM files WHERE path IS NOT NULL GROUP BY path),
    x AS (SELECT path, f.s AS size, f.m AS m, lower(regexp_extract(path, '([^/]*)$', 1)) AS name FROM l),
    r AS (SELECT path, size, CASE WHEN size = 0 THEN 'empty' WHEN regexp_matches(name, '([.](tmp|temp|bak|swp|orig)|~)$') THEN 'temporary'
      WHEN regexp_matches(path, '(^|/)(build|dist|target|out|node_modules|__pycache__)/') OR regexp_matches(name, '[.](o|pyc|class|min[.]js|min[.]css)$') THEN 'generated'
      WHEN m < TIMESTAMPTZ '{NOW}+00' - INTERVAL 365 DAY THEN 'stale' END AS reason FROM x)"""


@query(f"WITH {_CLEANUP} SELECT path, reason, size, NULL::VARCHAR AS other FROM r WHERE reason IS NOT NULL")
def cleanup_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Files that could go, without duplicates."""
    return A.cleanup_candidates(table(spark, d, "files"), now=NOW)


@query(
    f"""WITH RECURSIVE {_GREEDY}, {_CLEANUP}, d AS (SELECT DISTINCT duplicate AS path FROM dup), y AS (SELECT r.path, CASE WHEN d.path IS NOT NULL THEN 'duplicate' ELSE reason END AS reason FROM r LEFT JOIN d USING (path))
        SELECT 'delete' AS action, path AS source, NULL::VARCHAR AS target, CASE WHEN reason IN ('duplicate', 'empty') THEN 1.0::DOUBLE ELSE 0.5 END AS confidence, reason FROM y WHERE reason IS NOT NULL"""
)
def cleanup_plan(spark: SparkSession, d: str) -> DataFrame:
    """Delete actions for duplicates and other candidates."""
    return organize.deletions(A.cleanup_candidates(table(spark, d, "files"), duplicate_groups_greedy(spark, d), now=NOW))


def _kmeans_sql(k: int, rounds: int, source: str = "SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings", before: str = "") -> str:
    """Common table expressions that end in ``topics (id, topic, similarity)``."""
    parts = [
        f"""{before}src AS ({source}), e AS (SELECT id, v, row_number() OVER (ORDER BY id) - 1 AS p, count(*) OVER () AS n FROM src),
        c0 AS (SELECT j, e.v AS c FROM e, (SELECT unnest(range(0, {k})) AS j) WHERE p = j * least(CASE WHEN n > {k} THEN n // {k} ELSE 1 END, n - 1))"""
    ]
    for r in range(rounds):
        parts.append(
            f"""s{r} AS (SELECT id, v, j, {_cos("v", "c")} AS s FROM e, c{r}), a{r} AS (SELECT id, any_value(v) AS v, arg_min(j, struct_pack(a := -s, b := j)) AS j FROM s{r} GROUP BY id),
            u{r} AS (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}), m{r} AS (SELECT j, i, avg(x) AS x FROM u{r} GROUP BY j, i),
            n{r} AS (SELECT j, list(x ORDER BY i) AS v, sqrt(sum(x * x)) AS n FROM m{r} GROUP BY j),
            c{r + 1} AS (SELECT c{r}.j, coalesce(list_transform(n{r}.v, lambda x: x / n{r}.n), c{r}.c) AS c FROM c{r} LEFT JOIN n{r} USING (j))"""
        )
    last = f"s{rounds}"
    parts.append(f"{last} AS (SELECT id, j, {_cos('v', 'c')} AS s FROM e, c{rounds})")
    parts.append(f"topics AS (SELECT id, arg_min(j, struct_pack(a := -s, b := j))::INT AS topic, max(s) AS similarity FROM {last} GROUP BY id)")
    return ", ".join(parts)


@query(f"WITH {_kmeans_sql(6, 5)} SELECT id AS vec_id, topic, round(similarity, 5) AS similarity FROM topics")
def kmeans_topics(spark: SparkSession, d: str) -> DataFrame:
    """Five rounds of spherical k-means with six topics."""
    topics, _ = A.kmeans_topics(table(spark, d, "embeddings"), "vec_id", "embedding", 6)
    return topics.select(F.col("id").alias("vec_id"), "topic", F.round("similarity", 5).alias("similarity"))


@query(
    f"""WITH c AS (SELECT vec_id AS i, embedding AS cv FROM embeddings WHERE vec_id < 3), s AS (SELECT e.vec_id, i, {_cos("embedding", "cv")} AS s FROM embeddings e, c),
        b AS (SELECT vec_id, max(struct_pack(s := s, i := i)) AS b FROM s GROUP BY vec_id)
        SELECT vec_id, CASE WHEN b.s >= 0.3 THEN 'category_' || b.i END AS category, round(b.s, 6) AS similarity FROM b"""
)
def assign_categories(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of three named vectors."""
    names = {f"category_{i}": _vector(spark, d, i) for i in range(3)}
    return A.assign_categories(table(spark, d, "embeddings"), names, "vec_id", "embedding").select(F.col("id").alias("vec_id"), "category", F.round("similarity", 6).alias("similarity"))


_BY_TYPE = f"""{_LATEST_FILES}, t AS (SELECT path, coalesce(nullif({_EXT}, ''), nullif(split_part(coalesce(mime_type, ''), '/', 1), ''), 'other') AS kind FROM latest WHERE path = '/corpus' OR starts_with(path, '/corpus/')),
    act AS (SELECT DISTINCT 'mkdir' AS action, NULL::VARCHAR AS source, '/corpus/' || kind AS target, 1.0::DOUBLE AS confidence FROM t
      UNION ALL SELECT 'move', path, '/corpus/' || kind || '/' || regexp_extract(path, '([^/]*)$', 1), 1.0 FROM t WHERE path <> '/corpus/' || kind || '/' || regexp_extract(path, '([^/]*)$', 1))"""


@query(f"WITH {_BY_TYPE} SELECT * FROM act")
def by_type_plan(spark: SparkSession, d: str) -> DataFrame:
    return organize.by_type(table(spark, d, "files"), "/corpus").drop("reason")


@query(f"WITH {_BY_TYPE} SELECT 'tidy' AS plan_id, sum((action = 'mkdir')::INT)::BIGINT AS mkdir, sum((action = 'move')::INT)::BIGINT AS move, 0::BIGINT AS \"delete\" FROM act")
def kept_plan(spark: SparkSession, d: str) -> DataFrame:
    """A plan written for review, read back and summed up."""
    folder = f"{shared_dir(spark)}/plans-{uuid.uuid4().hex}"
    L.write_plan(organize.by_type(table(spark, d, "files"), "/corpus"), folder, "tidy", "by type")
    return L.summarize_plans(L.read_plans(spark, folder)).select("plan_id", "mkdir", "move", "delete")


@query(
    f"""WITH {_BY_TYPE} SELECT sum((action = 'move')::INT)::BIGINT AS files_affected, sum((action = 'mkdir')::INT)::BIGINT AS dirs_created,
        sum((action = 'move')::INT)::BIGINT AS files_moved, 0::BIGINT AS files_deleted FROM act"""
)
def plan_impact(spark: SparkSession, d: str) -> DataFrame:
    return organize.impact(organize.by_type(table(spark, d, "files"), "/corpus"))


@query(
    f"""WITH {_BY_TYPE}, m AS (SELECT target, count(*) AS sources FROM act WHERE action = 'move' GROUP BY target), mv AS (SELECT source FROM act WHERE action = 'move'),
        x AS (SELECT DISTINCT path FROM files WHERE path IS NOT NULL AND path NOT IN (SELECT source FROM mv))
        SELECT target, sources, x.path IS NOT NULL AS "exists" FROM m LEFT JOIN x ON x.path = target WHERE sources > 1 OR x.path IS NOT NULL"""
)
def plan_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Targets that several files claim or that exist."""
    files = table(spark, d, "files").where("path is not null")
    return organize.conflicts(organize.by_type(files, "/corpus"), files)


@query(
    """SELECT DISTINCT 'mkdir' AS action, NULL::VARCHAR AS source, '/corpus/' || split_part(substr(path, 9), '/', 1) AS target, 0.8::DOUBLE AS confidence FROM files
       WHERE starts_with(path, '/corpus/') AND split_part(substr(path, 9), '/', 1) <> '' AND NOT contains(split_part(substr(path, 9), '/', 1), '.')"""
)
def by_project_plan(spark: SparkSession, d: str) -> DataFrame:
    return organize.by_project(table(spark, d, "files"), "/corpus").drop("reason")


_TOPICS = _kmeans_sql(8, 5, "SELECT path AS id, centroid AS v FROM cen WHERE path = '/corpus' OR starts_with(path, '/corpus/')", f"{_CENTROIDS}, ")
_NAME = "regexp_extract({}, '([^/]*)$', 1)"


@query(
    f"""WITH {_TOPICS}, mv AS (SELECT id, '/corpus/topic_' || (topic + 1) || '/' || {_NAME.format("id")} AS target, greatest(similarity, 0.7) AS s, 'nearest topic ' || (topic + 1) AS reason FROM topics)
        SELECT 'mkdir' AS action, NULL::VARCHAR AS source, '/corpus/topic_' || (j + 1) AS target, 1.0::DOUBLE AS confidence, 'folder for topic ' || (j + 1) AS reason FROM c5
        UNION ALL SELECT 'move', id, target, round(s, 5), reason FROM mv WHERE id <> target"""
)
def by_topic_plan(spark: SparkSession, d: str) -> DataFrame:
    return organize.by_topic(A.file_centroids(_chunks(spark, d, "file_path", "embedding")), "/corpus", 8).withColumn("confidence", F.round("confidence", 5))


@query(
    f"""WITH {_CENTROIDS}, q AS (SELECT 'category_' || vec_id AS c, vec_id AS i, embedding AS cv FROM embeddings WHERE vec_id < 3),
        s AS (SELECT path, i, c, {_cos("centroid", "cv")} AS s FROM cen, q WHERE path = '/corpus' OR starts_with(path, '/corpus/')),
        b AS (SELECT path, max(struct_pack(s := s, i := i, c := c)) AS b FROM s GROUP BY path),
        mv AS (SELECT path, '/corpus/' || b.b.c || '/' || {_NAME.format("path")} AS target, b.b.s AS s, 'nearest category ' || b.b.c AS reason FROM b)
        SELECT 'mkdir' AS action, NULL::VARCHAR AS source, '/corpus/' || c AS target, 1.0::DOUBLE AS confidence, 'folder for ' || c AS reason FROM q
        UNION ALL SELECT 'move', path, target, round(s, 5), reason FROM mv WHERE path <> target"""
)
def by_category_plan(spark: SparkSession, d: str) -> DataFrame:
    names = {f"category_{i}": _vector(spark, d, i) for i in range(3)}
    return organize.by_category(A.file_centroids(_chunks(spark, d, "file_path", "embedding")), "/corpus", names, -1.0).withColumn("confidence", F.round("confidence", 5))


@query(
    """WITH c AS (SELECT count(DISTINCT chunk_id) AS chunks FROM chunks),
       f AS (SELECT path, max(struct_pack(i := coalesce(indexed_at, TIMESTAMPTZ '1970-01-01 00:00:00+00'), s := status, b := size_bytes)) AS f FROM files GROUP BY path)
       SELECT any_value(c.chunks) AS chunks, count(*) AS files, sum((f.f.s = 'indexed')::INT)::BIGINT AS indexed, sum((f.f.s = 'error')::INT)::BIGINT AS errors, sum(f.f.b)::BIGINT AS bytes FROM f, c"""
)
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.corpus_stats(table(spark, d, "chunks"), table(spark, d, "files"))


# ---------------------------------------------------------------- tables and changes


@query(
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC) AS r FROM chunks)
       SELECT file_path, count(*) AS chunks, sum(strlen(content))::BIGINT AS bytes, max(indexed_at) AS last FROM l WHERE r = 1 GROUP BY file_path"""
)
def upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A stored table that gets the first version of every chunk, and then the latest one of those that came twice."""
    rows = table(spark, d, "chunks")
    store = _store(spark)
    store.upsert_chunks(K.latest(rows.withColumn("_age", -F.unix_micros("indexed_at")), "chunk_id", "_age").drop("_age"))
    again = rows.join(rows.groupBy("chunk_id").agg(F.count("*").alias("_n")).where("_n > 1").select("chunk_id"), "chunk_id", "left_semi")
    store.upsert_chunks(K.latest(again, "chunk_id", "indexed_at"))
    out = store.read("chunks")
    return out.groupBy("file_path").agg(F.count("*").alias("chunks"), F.sum(F.octet_length("content").cast("long")).alias("bytes"), F.max("indexed_at").alias("last"))


def _store(spark: SparkSession) -> K.TableStore:
    """An empty store below the shared folder."""
    return K.TableStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


def _filled(spark: SparkSession, d: str) -> K.TableStore:
    """A store with the latest row of every chunk and file."""
    store, files = _store(spark), table(spark, d, "files").where("path is not null")
    store.upsert_chunks(_chunks(spark, d, "file_id", "file_path", "content", "content_type", "chunk_index"))
    store.upsert_files(K.latest(files.withColumn("_at", F.coalesce("indexed_at", F.lit("1970-01-01").cast("timestamp"))), "path", "_at", "modified_at", "file_id").drop("_at"))
    return store


_HOT = "/corpus/quarry/journal/agent_sessions.md"
_KEPT = "k AS (SELECT CASE WHEN file_path = '{hot}' THEN '/corpus/renamed.md' ELSE file_path END AS file_path, count(DISTINCT chunk_id) AS rows FROM chunks WHERE file_path IS NOT NULL GROUP BY 1)"
_RECORDS = "r AS (SELECT DISTINCT CASE WHEN path = '{hot}' THEN '/corpus/renamed.md' ELSE path END AS path FROM files WHERE path IS NOT NULL)"


@query(f"WITH {_KEPT.format(hot=_HOT)}, {_RECORDS.format(hot=_HOT)} SELECT r.path AS file_path, coalesce(rows, 0) AS rows FROM r LEFT JOIN k ON k.file_path = r.path")
def rename_path(spark: SparkSession, d: str) -> DataFrame:
    """A stored file under another path: its chunks and its record move, all others stay."""
    store = _filled(spark, d)
    store.rename(_HOT, "/corpus/renamed.md")
    held = store.read("chunks").groupBy("file_path").agg(F.count("*").alias("rows"))
    return store.read("files").select(F.col("path").alias("file_path")).join(held, "file_path", "left").select("file_path", F.coalesce("rows", F.lit(0)).alias("rows"))


@query(f"SELECT file_path, count(DISTINCT chunk_id) AS rows FROM chunks WHERE file_path <> '{_HOT}' GROUP BY 1")
def delete_path(spark: SparkSession, d: str) -> DataFrame:
    """A stored file removed with its chunks."""
    store = _filled(spark, d)
    store.delete(_HOT)
    return store.read("chunks").join(store.read("files").select(F.col("path").alias("file_path")), "file_path", "left_semi").groupBy("file_path").agg(F.count("*").alias("rows"))


@query(f"SELECT chunk_id, chunk_index, md5(any_value(content)) AS digest FROM chunks WHERE file_path = '{_HOT}' GROUP BY 1, 2")
def chunks_of_path(spark: SparkSession, d: str) -> DataFrame:
    """The stored chunks of one file; one bucket is read."""
    return _filled(spark, d).chunks_of(_HOT).select("chunk_id", "chunk_index", F.md5("content").alias("digest"))


@query(
    f"""WITH l AS (SELECT path, arg_max(struct_pack(f := file_id, h := content_hash, s := status, n := chunk_count),
          struct_pack(i := coalesce(indexed_at, TIMESTAMPTZ '1970-01-01 00:00:00+00'), m := modified_at, f := file_id)) AS r FROM files WHERE path = '{_HOT}' GROUP BY path)
        SELECT path, r.f AS file_id, r.h AS content_hash, r.s AS status, r.n AS chunk_count FROM l"""
)
def file_record(spark: SparkSession, d: str) -> DataFrame:
    """The stored record of one file."""
    return _filled(spark, d).file(_HOT).select("path", "file_id", "content_hash", "status", "chunk_count")


@query("SELECT (SELECT count(DISTINCT chunk_id) FROM chunks WHERE file_path IS NOT NULL) AS chunks, (SELECT count(DISTINCT path) FROM files WHERE path IS NOT NULL) AS files, true AS has_bytes")
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    """What a store holds."""
    return _filled(spark, d).stats().select("chunks", "files", (F.col("bytes") > 0).alias("has_bytes"))


_CTOK = "tok AS (SELECT chunk_id, any_value(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) AS t FROM chunks WHERE content IS NOT NULL AND file_path IS NOT NULL GROUP BY chunk_id), d AS (SELECT chunk_id, t, len(t) AS dl FROM tok WHERE len(t) > 0)"


@query(
    f"""WITH {_CTOK}, n AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM d), tf AS (SELECT chunk_id, dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM d, (SELECT unnest(string_split('{_WORDS}', ' ')) AS term)),
        df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term)
        SELECT chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25 FROM tf JOIN df USING (term), n WHERE tf > 0 GROUP BY chunk_id"""
)
def store_fulltext(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over the full-text index that a store keeps of its chunks."""
    found = _filled(spark, d).fulltext().search(_WORDS)
    return found.select(F.col("id").alias("chunk_id"), F.round("bm25", 6).alias("bm25"))


@query("WITH h AS (SELECT DISTINCT * FROM op_history WHERE entry_id IS NOT NULL) SELECT operation, count(*) AS entries, count(undo_data) AS with_undo FROM h GROUP BY 1")
def history_log(spark: SparkSession, d: str) -> DataFrame:
    """Operations appended to a log of JSON lines and read back."""
    folder = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    L.append_history(table(spark, d, "op_history").where("entry_id is not null").distinct(), folder)
    return L.read_history(spark, folder).groupBy("operation").agg(F.count("*").alias("entries"), F.count("undo_data").alias("with_undo"))


def _snapshot(files: DataFrame) -> DataFrame:
    """A made-up later state: some files gone, some changed, some moved."""
    now = files.where("path is not null and status <> 'deleted'").groupBy("path").agg(F.max("content_hash").alias("h")).where("substr(h, 1, 1) <> '0'")
    moved = F.when(F.expr("substr(h, 1, 1) = '2'"), F.concat("path", F.lit(".moved"))).otherwise(F.col("path"))
    return now.select(moved.alias("path"), F.when(F.expr("substr(h, 1, 1) = '1'"), F.concat("h", F.lit("x"))).otherwise(F.col("h")).alias("content_hash"))


_SNAPSHOT = """now AS (SELECT path, max(content_hash) AS h FROM files WHERE path IS NOT NULL AND status <> 'deleted' GROUP BY path),
    snap AS (SELECT CASE WHEN substr(h, 1, 1) = '2' THEN path || '.moved' ELSE path END AS path, CASE WHEN substr(h, 1, 1) = '1' THEN h || 'x' ELSE h END AS h FROM now WHERE substr(h, 1, 1) <> '0'),
    old AS (SELECT path, max(struct_pack(h := content_hash, s := status)) AS o FROM files WHERE path IS NOT NULL AND status <> 'deleted' GROUP BY path)"""


@query(
    f"""WITH {_SNAPSHOT}, b AS (SELECT coalesce(s.path, o.path) AS path, s.h, o.o.h AS oh, CASE WHEN o.path IS NULL THEN 'created' WHEN s.path IS NULL THEN 'deleted'
          WHEN s.h IS DISTINCT FROM o.o.h OR o.o.s <> 'indexed' THEN 'modified' END AS kind FROM snap s FULL JOIN old o ON s.path = o.path),
        born AS (SELECT path, h, row_number() OVER (PARTITION BY h ORDER BY path) AS r FROM b WHERE kind = 'created'), died AS (SELECT path, oh AS h, row_number() OVER (PARTITION BY oh ORDER BY path) AS r FROM b WHERE kind = 'deleted'),
        mv AS (SELECT died.path AS f, born.path AS t FROM born JOIN died USING (h, r))
        SELECT kind, path, NULL::VARCHAR AS to_path FROM b WHERE kind IS NOT NULL AND path NOT IN (SELECT f FROM mv) AND path NOT IN (SELECT t FROM mv)
        UNION ALL SELECT 'renamed', f, t FROM mv"""
)
def incremental_changes(spark: SparkSession, d: str) -> DataFrame:
    """What has been created, modified, deleted and renamed since."""
    files = table(spark, d, "files")
    return I.diff(_snapshot(files), files)


@query(f"WITH {_SNAPSHOT}, f AS (SELECT path, max(content_hash) AS h FROM files GROUP BY path) SELECT snap.path, snap.h IS DISTINCT FROM f.h AS needs_reindex FROM snap LEFT JOIN f ON f.path = snap.path")
def needs_reindex(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files")
    return I.needs_reindex(_snapshot(files), files)


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seen_at DESC, feed_id DESC) AS r FROM file_feed WHERE path IS NOT NULL)
       SELECT path, feed_id, kind, to_path, seen_at FROM r WHERE r = 1"""
)
def latest_event_per_path(spark: SparkSession, d: str) -> DataFrame:
    return I.latest_per_path(table(spark, d, "file_feed")).select("path", "feed_id", "kind", "to_path", "seen_at")


@query("SELECT date_trunc('hour', seen_at) AS started, kind, count(*) AS events FROM file_feed GROUP BY 1, 2")
def feed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Changes per hour of event time and kind."""
    return I.windowed_counts(table(spark, d, "file_feed"))


@query(
    """WITH g AS (SELECT path, seen_at, CASE WHEN seen_at < lag(seen_at) OVER w + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM file_feed WHERE path IS NOT NULL WINDOW w AS (PARTITION BY path ORDER BY seen_at, feed_id)),
       s AS (SELECT path, seen_at, sum(new) OVER (PARTITION BY path ORDER BY seen_at ROWS UNBOUNDED PRECEDING) AS k FROM g)
       SELECT path, count(*) AS events, min(seen_at) AS started, max(seen_at) + INTERVAL 10 MINUTE AS settled FROM s GROUP BY path, k"""
)
def debounced_events(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of changes of a path with ten quiet minutes after each."""
    return I.debounced(table(spark, d, "file_feed").where("path is not null"), quiet="10 minutes").select("path", "events", "started", "settled")


@query("SELECT date_trunc('hour', seen_at) AS started, kind, count(*) AS events FROM file_feed GROUP BY 1, 2")
def streamed_feed(spark: SparkSession, d: str) -> DataFrame:
    """The change feed through Structured Streaming: hourly counts of the whole feed."""
    feed = spark.readStream.schema(table(spark, d, "file_feed").schema).parquet(f"{d}/file_feed*.parquet" if not d.endswith(".parquet") else d)
    name = f"feed_{uuid.uuid4().hex}"
    counts = I.windowed_counts(feed)
    run = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{shared_dir(spark)}/{name}").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


# ---------------------------------------------------------------- operations

_LAST = "h AS (SELECT DISTINCT ON (entry_id) * FROM op_history WHERE entry_id IS NOT NULL ORDER BY entry_id)"


@query(
    f"""WITH {_LAST} SELECT operation, count(*) AS entries, sum(coalesce(NOT success, false)::INT)::BIGINT AS failed,
        sum(coalesce(success AND reversible AND undo_data IS NOT NULL, false)::INT)::BIGINT AS undoable FROM h GROUP BY operation"""
)
def history_summary(spark: SparkSession, d: str) -> DataFrame:
    return O.history_summary(table(spark, d, "op_history"))


@query(f"WITH {_LAST} SELECT entry_id, operation, path, logged_at FROM h ORDER BY logged_at DESC, entry_id LIMIT 50")
def recent_history(spark: SparkSession, d: str) -> DataFrame:
    return O.history(table(spark, d, "op_history"), 50).select("entry_id", "operation", "path", "logged_at")


@query(f"WITH {_LAST} SELECT entry_id, operation, path FROM h WHERE success AND reversible AND undo_data IS NOT NULL AND json_valid(undo_data)")
def undoable_operations(spark: SparkSession, d: str) -> DataFrame:
    return O.undoable(table(spark, d, "op_history")).select("entry_id", "operation", "path")


@query(
    f"""SELECT DISTINCT ON (trash_id) trash_id, original_path, size_bytes, coalesce(expires_at < TIMESTAMPTZ '{NOW}+00', false) AS expired FROM trash_entries WHERE trash_id IS NOT NULL"""
)
def trash_state(spark: SparkSession, d: str) -> DataFrame:
    return O.trash_state(table(spark, d, "trash_entries"), NOW)


@query(
    f"""WITH t AS (SELECT original_path, max(struct_pack(d := deleted_at, i := trash_id, s := size_bytes)) AS t FROM trash_entries WHERE trash_id IS NOT NULL AND (expires_at IS NULL OR expires_at >= TIMESTAMPTZ '2025-06-01 00:00:00+00') GROUP BY original_path),
        f AS (SELECT DISTINCT path FROM files WHERE status <> 'deleted')
        SELECT original_path, t.t.i AS trash_id, t.t.s AS size_bytes, f.path IS NULL AS free FROM t LEFT JOIN f ON f.path = original_path"""
)
def restorable(spark: SparkSession, d: str) -> DataFrame:
    return O.restorable(table(spark, d, "trash_entries"), table(spark, d, "files"), "2025-06-01 00:00:00")


@query(
    f"""WITH {_LAST}, f AS (SELECT DISTINCT path FROM files WHERE coalesce(status, 'pending') <> 'deleted' AND path IS NOT NULL)
        SELECT entry_id, operation AS op, h.path, CASE WHEN h.path IS NULL OR operation IS NULL THEN 'not an operation'
          WHEN operation NOT IN ('create', 'delete', 'move', 'copy', 'write', 'mkdir', 'symlink') THEN 'unknown operation'
          WHEN operation IN ('create', 'mkdir', 'symlink') AND f.path IS NOT NULL THEN 'exists already'
          WHEN operation IN ('move', 'copy', 'delete') AND f.path IS NULL THEN 'does not exist'
          WHEN operation IN ('move', 'copy') AND g.path IS NOT NULL THEN 'target exists already' END AS problem
        FROM h LEFT JOIN f ON f.path = h.path LEFT JOIN f g ON g.path = h.path || '.new'"""
)
def validate_operations(spark: SparkSession, d: str) -> DataFrame:
    """A dry run of every recorded operation against the files table."""
    ops = table(spark, d, "op_history").where("entry_id is not null").dropDuplicates(["entry_id"])
    ops = ops.select("entry_id", F.col("operation").alias("op"), "path", F.concat("path", F.lit(".new")).alias("to_path"))
    return O.validate(ops, table(spark, d, "files")).select("entry_id", "op", "path", "problem")



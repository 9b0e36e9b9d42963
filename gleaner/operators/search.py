"""Vector and hybrid search over the chunks table; filters always come before the score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import preview
from gleaner.functions.vectors import literal_vector, metric_score
from gleaner.operators.embedding import Embedder
from gleaner.operators.fulltext import StoredIndex, bm25, reciprocal_rank_fusion
from gleaner.plans.dsl import Filter, Query, apply_filters, parse

RESULT = ("chunk_id", "file_path", "content", "score", "start_byte", "end_byte", "start_line", "end_line")


@dataclass
class SearchRequest:
    vector: list[float] | None = None
    text: str | None = None
    limit: int = 10
    filters: list[Filter] = field(default_factory=list)
    metric: str = "cosine"


def top_k(df: DataFrame, vector: list[float], k: int, vec_col: str = "embedding", id_col: str = "chunk_id", metric: str = "cosine") -> DataFrame:
    """``df`` with a ``score`` column, the ``k`` best rows, ties by id.

    Rows without a vector or with one of another length score null (0 under cosine) and null
    scores come last. The plan is a scan, a projection and a bounded top-n per task.
    """
    scored = df.withColumn("score", metric_score(metric, F.col(vec_col), literal_vector(vector)))
    return scored.orderBy(F.desc_nulls_last("score"), id_col).limit(k)


def batch_top_k(queries: DataFrame, rows: DataFrame, k: int, query_id: str, row_id: str, vec_col: str = "embedding", dim: int = 64, exclude_self: bool = False, block: int = 65_536) -> DataFrame:
    """The ``k`` best rows by cosine for every query: ``(query_id, row_id, score, rank)``.

    Queries and rows are cut by hash into parts; a task holds one part of at most about ``block`` queries and
    streams one part of the rows past it as matrix products, keeping the best ``k`` of each query, and a
    bounded merge follows. Nothing is collected; rows are copied once per part of the queries and
    queries once per part of the rows. Zero vectors score 0; null vectors, vectors
    of another length and null ids take no part; repeated ids count once; ties are ranked by row id.
    """
    q = queries.select(F.col(query_id).alias("q"), F.col(vec_col).cast("array<float>").alias("v")).where(F.col("q").isNotNull() & (F.size("v") == dim)).dropDuplicates(["q"])
    r = rows.select(F.col(row_id).alias("r"), F.col(vec_col).cast("array<float>").alias("v")).where(F.col("r").isNotNull() & (F.size("v") == dim)).dropDuplicates(["r"])
    q_type, r_type = q.schema["q"].dataType.simpleString(), r.schema["r"].dataType.simpleString()
    asks, given = q.count(), r.count()
    if not asks or not given:
        return rows.sparkSession.createDataFrame([], f"{query_id} {q_type}, {row_id} {r_type}, score double, rank int")
    across = -(-asks // block)
    down = min(max(-(-given // (8 * block)), -(-rows.sparkSession.sparkContext.defaultParallelism // across)), -(-given // 1024))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda t: F.lit(None).cast(t)
    left = q.select(F.lit(0).cast("byte").alias("kind"), part("q", across).alias("i"), every(down).alias("j"), "q", none(r_type).alias("r"), "v")
    right = r.select(F.lit(1).cast("byte").alias("kind"), every(across).alias("i"), part("r", down).alias("j"), none(q_type).alias("q"), "r", "v")
    tiles = left.unionByName(right).select((F.col("i") * down + F.col("j")).alias("tile"), "kind", "q", "r", "v")
    tiles = tiles.repartitionById(across * down, F.col("tile")).sortWithinPartitions("tile", "kind")

    def units(column: pa.Array) -> np.ndarray:
        x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one tile at a time, its queries first."""
        current, held, names, m = None, [], None, None
        for b in batches:
            tile, kind = b.column("tile").to_numpy(), b.column("kind").to_numpy()
            change = np.flatnonzero(np.diff(tile.astype(np.int64) * 2 + kind)) + 1
            for lo, hi in zip(np.append(0, change), np.append(change, len(tile)), strict=True):
                if lo == hi:
                    continue
                if tile[lo] != current:
                    current, held, names, m = tile[lo], [], None, None
                rows_ = b.slice(lo, hi - lo)
                if kind[lo] == 0:
                    held.append((rows_.column("q"), units(rows_.column("v"))))
                    continue
                if not held:
                    continue
                if m is None:
                    names, m = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
                x, ids = units(rows_.column("v")), rows_.column("r")
                own = pc.index_in(names.cast(ids.type), ids).to_numpy(zero_copy_only=False) if exclude_self else None
                keep, step = min(k, len(x)), max(1, 4_000_000 // len(x))
                for at in range(0, len(m), step):
                    s = m[at : at + step] @ x.T
                    if own is not None:
                        here = own[at : at + step].astype(np.float64)
                        mine = np.flatnonzero(~np.isnan(here))
                        s[mine, here[mine].astype(np.int64)] = -2
                    least = np.partition(s, -keep, axis=1)[:, -keep]
                    a, c = np.nonzero(s >= least[:, None] - 1e-12)
                    ok = s[a, c] > -1.5
                    a, c = a[ok], c[ok]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(at + a)), ids.take(pa.array(c)), pa.array(s[a, c])], ["q", "r", "score"])

    found = tiles.mapInArrow(run, f"q {q_type}, r {r_type}, score double").withColumn("score", F.round("score", 9)).dropDuplicates(["q", "r"])
    order = Window.partitionBy("q").orderBy(F.desc("score"), "r")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("q").alias(query_id), F.col("r").alias(row_id), "score", F.col("rank").cast("int").alias("rank"))


def hybrid(
    df: DataFrame, text: str, vector: list[float], k: int, depth: int | None = None, text_col: str = "content", vec_col: str = "embedding", id_col: str = "chunk_id", metric: str = "cosine", index: StoredIndex | None = None, filtered: bool = False
) -> DataFrame:
    """``(id, vector_score, bm25, rrf_score)``: the vector list and the BM25 list fused by reciprocal rank.

    An ``index`` answers for the texts; if it covers more rows than ``df`` (``filtered``) only those of ``df`` count.
    """
    depth = depth or max(50, 5 * k)
    near = df.select(id_col, metric_score(metric, F.col(vec_col), literal_vector(vector)).alias("vector_score"))
    words = bm25(df, id_col, text_col, text, index).withColumnRenamed("id", id_col)
    if index is not None and filtered:
        words = words.join(df.select(id_col), id_col, "left_semi")
    fused = reciprocal_rank_fusion(near, words, id_col, "vector_score", "bm25", depth)
    return fused.orderBy(F.desc("rrf_score"), id_col).limit(k)


def search(chunks: DataFrame, request: SearchRequest, files: DataFrame | None = None, vec_col: str = "embedding", index: StoredIndex | None = None) -> DataFrame:
    """Results of a request; with a text and a vector the hybrid list, with one of them that list.

    A stored ``index`` of the chunks answers for the texts; how rare a term is then refers to all chunks, without it to those the filters leave.
    """
    rows = apply_filters(chunks, request.filters, files)
    if request.vector is not None and not (request.text or "").strip():
        found = top_k(rows, request.vector, request.limit, vec_col, "chunk_id", request.metric)
    else:
        if request.vector is None:
            words = bm25(rows, "chunk_id", "content", request.text or "", index)
            if index is not None and request.filters:
                words = words.join(rows.select(F.col("chunk_id").alias("id")), "id", "left_semi")
            fused = words.select(F.col("id").alias("chunk_id"), F.col("bm25").alias("score")).orderBy(F.desc("score"), "chunk_id").limit(request.limit)
        else:
            fused = hybrid(rows, request.text or "", request.vector, request.limit, vec_col=vec_col, metric=request.metric, index=index, filtered=bool(request.filters)).select("chunk_id", F.col("rrf_score").alias("score"))
        found = rows.join(F.broadcast(fused), "chunk_id").orderBy(F.desc("score"), "chunk_id")  # at most limit rows
    return found.select(*(c for c in RESULT if c in found.columns))


def run_query(chunks: DataFrame, query: str | Query, embedder: Embedder, files: DataFrame | None = None, hybrid_search: bool = True, vec_col: str = "embedding", index: StoredIndex | None = None) -> DataFrame:
    """Parse a query string, embed its text and search."""
    q = parse(query) if isinstance(query, str) else query
    vector = list(chunks.sparkSession.range(1).select(embedder.embed(F.lit(q.text)).alias("v")).first().v)
    return search(chunks, SearchRequest(vector, q.text if hybrid_search else None, q.limit, q.filters, q.metric), files, vec_col, index)


def similar_files(chunks: DataFrame, path: str, vector: list[float], k: int, distinct_files: bool = False, vec_col: str = "embedding") -> DataFrame:
    """The chunks nearest to a file's vector outside of it, or the best chunk of each of ``k`` files."""
    rows = chunks.where(F.col("file_path") != path)
    rows = rows.withColumn("score", metric_score("cosine", F.col(vec_col), literal_vector(vector)))
    if distinct_files:
        best = F.max(F.struct(F.col("score"), F.col("chunk_id"), F.col("content"))).alias("b")
        rows = rows.groupBy("file_path").agg(best).select("file_path", "b.chunk_id", "b.content", "b.score")
    found = rows.orderBy(F.desc("score"), "chunk_id").limit(k)
    return found.select("file_path", "chunk_id", "score", preview(F.col("content"), 200).alias("preview"))


def as_documents(results: DataFrame) -> DataFrame:
    """Results as ``(page_content, metadata)`` with the ranges, path, score and id as strings."""
    names = [c for c in results.columns if c != "content"]
    pairs = [x for c in names for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    return results.select(F.col("content").alias("page_content"), F.create_map(*pairs).alias("metadata"))


def as_json(results: DataFrame, query: str, snippet_length: int = 500) -> DataFrame:
    """One row: the query and its results as a JSON text, best first."""
    cut = F.when(F.char_length("content") > snippet_length, F.concat(F.substring("content", 1, snippet_length), F.lit("..."))).otherwise(F.col("content"))
    rows = results.select(F.struct((-F.col("score")).alias("o"), F.col("file_path").alias("file"), F.col("score"), cut.alias("content")).alias("r"))
    packed = rows.agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: F.struct(r["file"].alias("file"), r["score"].alias("score"), r["content"].alias("content"))).alias("results"))
    return packed.select(F.to_json(F.struct(F.lit(query).alias("query"), "results")).alias("json"))

"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import clusters, handwritten, leakage, near_duplicates, packing, reading_level, splitting
from gleaner.llm.neighbours import similar_vectors
from gleaner.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of different files with cosine 0.96 or more, one among the five nearest of the other."""
    near = similar_vectors(table(spark, sf_dir, "chunks"), "chunk_id", "file_path", "embedding", k=5, min_cosine=0.96)
    return near.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b")).distinct()


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar chunks of other files for every chunk with a non-zero vector."""
    near = similar_vectors(table(spark, sf_dir, "chunks"), "chunk_id", "file_path", "embedding", k=5)
    return near.select(F.col("id").alias("chunk_id"), "neighbour", F.round("cosine", 5).alias("cosine"), "rank")


def _triples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates.similar_sets(table(spark, sf_dir, "chunks"), "chunk_id", "file_path", "content", threshold=0.5, shingle=3, least=20)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of different files that share at least half of their word triples."""
    found = near_duplicates.pairs(*_triples(spark, sf_dir))
    return found.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of 20 words or more with its group of near-duplicates, its class of copies and its number of links."""
    found = near_duplicates.groups(*_triples(spark, sf_dir))
    return found.select(F.col("id").alias("chunk_id"), F.col("grp").alias("file_path"), "group_id", "class_id", "links")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files that are generated, minified, vendored or data."""
    return p3_scores(spark, sf_dir).where("found").select("path")


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source file with its own notice, the forest's vote and the decision."""
    return handwritten.find_foreign_files(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "files"))


def p3_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vote on files that were kept out of training."""
    return handwritten.held_out_accuracy(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "files"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.materialize(clusters.group_vectors(table(spark, sf_dir, "chunks"), "chunk_id", "file_path", "embedding"), "files")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in clusters of at least five, linked by cosine 0.6 or more, with the cluster's smallest path."""
    found = clusters.link_clusters(_files(spark, sf_dir), min_cosine=0.6, least=5)
    return found.select(F.col("id").alias("path"), F.col("cluster").alias("cluster_path"))


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster's size and its five most typical files."""
    files = _files(spark, sf_dir)
    found = clusters.link_clusters(files, min_cosine=0.6, least=5)
    return clusters.describe(files, found).select(F.col("cluster").alias("cluster_path"), "size", "typical")


def p4_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by topic of their texts: hashed weighted features, k-means, and the members nearest each centroid."""
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "content")
    return clusters.text_topics(chunks, "chunk_id", "content")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of more than 4,096 bytes, and whether some stretch of them has no natural boundary."""
    cut = splitting.split_oversized(table(spark, sf_dir, "chunks"), with_content=False)
    return cut.where("piece = 0").select(F.col("id").alias("chunk_id"), "forced")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized chunk with byte ranges within its content."""
    cut = splitting.split_oversized(table(spark, sf_dir, "chunks"))
    return cut.select(F.col("id").alias("chunk_id"), F.col("piece").alias("chunk_index"), "start_byte", "end_byte", "fresh_byte", "natural", "content")


def p5_reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks, oversized ones replaced by their pieces, with a running index per file."""
    chunks = table(spark, sf_dir, "chunks")
    return splitting.reindex(chunks, splitting.split_oversized(chunks, with_content=False))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in containers of at most 2,048 tokens, 16 segments and 2,016 loss-bearing tokens."""
    return packing.fill_containers(table(spark, sf_dir, "documents"))


def p6_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are and which limits they reach."""
    return packing.utilisation(p6_containers(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least 12 consecutive words of a held-out item."""
    return p7_coverage(spark, sf_dir).select("doc_id", "item_id")


def p7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with their tiles and the share of the item that they cover."""
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs in which tiles cover at least half of the item, in whatever order they stand."""
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), min_coverage=0.5)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of every document of English prose."""
    return p8_difficulty(spark, sf_dir).select("doc_id", "reading_level")


def p8_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the continuous difficulty."""
    return reading_level.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p8_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy on held-out grades."""
    return reading_level.held_out_accuracy(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


_CHUNKS = "c AS (SELECT DISTINCT ON (chunk_id) chunk_id, file_path, content, embedding FROM chunks ORDER BY chunk_id)"
_UNIT = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))"

ORACLES = {
    "p1_found": f"""WITH {_CHUNKS}, v AS (SELECT chunk_id, file_path, embedding::DOUBLE[] AS v FROM c WHERE list_max(list_transform(embedding, lambda x: abs(x))) > 0),
        s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM v a JOIN v b ON a.file_path <> b.file_path),
        k AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM s WHERE s >= 0.96)
        SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM k WHERE r <= 5""",
    "p2_found": f"""WITH {_CHUNKS}, w AS (SELECT chunk_id, file_path, regexp_extract_all(lower(content), '[a-z0-9_]+') AS w FROM c),
        t AS (SELECT chunk_id, file_path, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS t FROM w WHERE len(w) >= 20),
        u AS (SELECT chunk_id, file_path, len(t) AS n, unnest(t) AS x FROM t),
        p AS (SELECT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b, count(*) AS common, any_value(a.n + b.n) AS total FROM u a JOIN u b ON a.x = b.x AND a.chunk_id < b.chunk_id AND a.file_path <> b.file_path GROUP BY 1, 2)
        SELECT chunk_a, chunk_b FROM p WHERE common::DOUBLE / (total - common) >= 0.5""",
    "p4_found": f"""WITH RECURSIVE {_CHUNKS}, u AS (SELECT file_path AS path, unnest({_UNIT}) AS x, generate_subscripts(embedding, 1) AS i FROM c WHERE list_max(list_transform(embedding, lambda x: abs(x))) > 0),
        m AS (SELECT path, i, avg(x) AS x FROM u GROUP BY path, i), f AS (SELECT path, list(x ORDER BY i) AS v FROM m GROUP BY path),
        e AS (SELECT a.path AS a, b.path AS b FROM f a JOIN f b ON a.path <> b.path WHERE list_cosine_similarity(a.v, b.v) >= 0.6),
        reach AS (SELECT path, path AS root FROM f UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.path),
        g AS (SELECT path, min(root) AS cluster_path FROM reach GROUP BY path)
        SELECT path, cluster_path FROM g WHERE cluster_path IN (SELECT cluster_path FROM g GROUP BY 1 HAVING count(*) >= 5)""",
    "p5_found": f"""WITH {_CHUNKS}, b AS (SELECT chunk_id, replace(regexp_replace(content, '([.!?])([ \\t\\r\\n])', '\\1' || chr(1) || '\\2', 'g'), chr(10), chr(10) || chr(1)) AS t FROM c WHERE strlen(content) > 4096)
        SELECT chunk_id, (list_max(list_transform(string_split(t, chr(1)), lambda x: strlen(x))) > 4096)::INT AS forced FROM b""",
    "p7_found": """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items),
        dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
        ig AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM i WHERE len(w) >= 12)
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

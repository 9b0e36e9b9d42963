"""Full-text search: a stored inverted index, and BM25 over it or over the texts themselves."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.runtime import materialize, spread

K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}]+"
#: Folders that the postings of an index lie in, by a hash of the term, and tasks that share one when it is written.
BUCKETS, WRITERS = 32, 4


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def inverted_index(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(term, id, tf, dl)``: how often each term stands in a text of ``dl`` terms."""
    rows = df.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t")).where(F.size("t") > 0)
    return rows.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def query_terms(query: str) -> list[str]:
    import regex

    return sorted(set(regex.findall(TOKEN, query.lower())))


def _scores(hits: DataFrame, n: int, words: int) -> DataFrame:
    """``(id, bm25)`` from the postings of a query's terms and the totals of the collection."""
    freq = hits.groupBy("term").agg(F.count("*").alias("df"))  # one row a term
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(words / max(n, 1))))
    return hits.join(F.broadcast(freq), "term").groupBy("id").agg(F.sum(part).alias("bm25"))


@dataclass
class StoredIndex:
    """Postings on disk in folders by term, ordered by term, and the totals of the collection.

    A query reads the folders of its terms, and of these the row groups that hold them.
    """

    spark: SparkSession
    paths: list[str]
    documents: int
    words: int
    buckets: int = BUCKETS
    id_type: str = "string"

    @classmethod
    def build(cls, df: DataFrame, id_col: str, text_col: str, folder: str, buckets: int = BUCKETS) -> StoredIndex:
        """Write the index of the rows with an id and a text of at least one term; an id must not repeat."""
        rows = inverted_index(spread(df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col)), id_col, text_col)
        rows = rows.withColumn("_term", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        # a term may be in every text: several tasks a folder
        rows = rows.repartition(F.col("_term"), F.pmod(F.xxhash64("id"), F.lit(WRITERS))).sortWithinPartitions("_term", "term")
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("_term").parquet(folder)
        kind = df.schema[id_col].dataType.simpleString()
        return cls(df.sparkSession, [folder], *totals(df.sparkSession, folder, kind), buckets, kind)

    def postings(self, terms: list[str]) -> DataFrame:
        rows = [_read(self.spark, p, self.id_type) for p in self.paths]
        found = rows[0]
        for more in rows[1:]:
            found = found.unionByName(more)
        where = [r[0] for r in self.spark.range(1).select(F.explode(F.array(*(F.pmod(F.xxhash64(F.lit(t)), F.lit(self.buckets)).cast("int") for t in terms)))).collect()]
        return found.where(F.col("_term").isin(where) & F.col("term").isin(terms)).drop("_term")

    def search(self, query: str) -> DataFrame:
        """``(id, bm25)`` of the texts that share a term with the query; a query without terms gives no rows."""
        terms = query_terms(query)
        if not terms or not self.paths:
            return self.spark.createDataFrame([], f"id {self.id_type}, bm25 double")
        return _scores(self.postings(terms), self.documents, self.words)


def _read(spark: SparkSession, folder: str, id_type: str) -> DataFrame:
    return spark.read.schema(f"term string, id {id_type}, tf long, dl int, _term int").parquet(folder)


def totals(spark: SparkSession, folder: str, id_type: str = "string") -> tuple[int, int]:
    """Texts and words of the postings in a folder."""
    rows = _read(spark, folder, id_type).groupBy("id").agg(F.first("dl").alias("dl"))
    r = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("w")).first()
    return r.n, r.w


def bm25(df: DataFrame, id_col: str, text_col: str, query: str, index: StoredIndex | None = None) -> DataFrame:
    """``(id, bm25)`` of the rows that share a term with the query.

    With an index its postings answer. Without one the query's terms are counted in one pass
    over the texts. Null and wordless texts count as no
    documents; a query without terms gives no rows. A repeated id counts as one text each time.
    """
    if index is not None:
        return index.search(query)
    terms = query_terms(query)
    spark = df.sparkSession
    if not terms:
        return spark.createDataFrame([], f"id {df.schema[id_col].dataType.simpleString()}, bm25 double")
    rows = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("x"))).select("id", tokens(F.col("x")).alias("t")).where(F.size("t") > 0)
    times = lambda term: F.size("t") - F.size(F.array_remove("t", term))
    rows = materialize(rows.select("id", F.size("t").alias("dl"), F.array(*(times(t) for t in terms)).alias("tf")), "ft-counts")
    tf = [F.col("tf")[i] for i in range(len(terms))]
    t = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"), *(F.sum((x > 0).cast("long")).alias(f"df{i}") for i, x in enumerate(tf))).first()
    score, hit = F.lit(0.0), F.lit(False)
    for i, x in enumerate(tf if t.n else []):
        idf = math.log(1 + (t.n - t[f"df{i}"] + 0.5) / (t[f"df{i}"] + 0.5))
        score = score + idf * x * (K1 + 1) / (x + K1 * (1 - B + B * F.col("dl") / t.mean))
        hit = hit | (x > 0)
    return rows.where(hit).select("id", score.alias("bm25"))


def reciprocal_rank_fusion(left: DataFrame, right: DataFrame, key: str, left_score: str, right_score: str, depth: int, k: int = 60) -> DataFrame:
    """Two ranked lists as one: each of the best ``depth`` rows of a list adds ``1 / (k + rank)``.

    Ties are ranked by the key. Returns the key, both scores and ``rrf_score``.
    """

    def ranked(df: DataFrame, score: str, name: str) -> DataFrame:
        top = df.where(F.col(score).isNotNull()).orderBy(F.desc(score), key).limit(depth)
        return top.select(key, score, F.row_number().over(Window.orderBy(F.desc(score), key)).alias(name))  # at most depth rows

    both = ranked(left, left_score, "ra").join(ranked(right, right_score, "rb"), key, "full")
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(r)), F.lit(0.0))
    return both.select(key, left_score, right_score, (part("ra") + part("rb")).alias("rrf_score"))

"""One facade over the operators: a corpus kept in a table store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.config import Settings
from gleaner.operators import analytics, search
from gleaner.operators.chunking import chunk_documents
from gleaner.operators.embedding import Embedder, HashEmbedder, ZeroEmbedder, embed_distinct
from gleaner.operators.store import MemoryStore, TableStore
from gleaner.plans import dsl, organize
from gleaner.streaming.indexer import Indexer


class Corpus:
    """Index folders or tables of texts, search them, and plan their tidying; results are DataFrames."""

    def __init__(self, spark: SparkSession, path: str | None, settings: Settings | None = None, embedder: Embedder | None = None):
        """``path`` is the store's folder; without one the rows are held in memory."""
        self.spark, self.settings = spark, settings or Settings()
        self.store = MemoryStore(spark) if path is None else TableStore(spark, path, self.settings.index.buckets or None)
        dim = self.settings.embedding.dim
        self.embedder = embedder or (ZeroEmbedder(dim) if self.settings.embedding.model == "zero" else HashEmbedder(dim))

    # ---- content

    def indexer(self, **given) -> Indexer:
        s = self.settings.index
        return Indexer(self.store, self.embedder, self.settings.chunk_config(), s.include or None, s.exclude, s.max_file_size, strict_types=s.strict_types, **given)

    def index(self, root: str, force: bool = False) -> DataFrame:
        """Bring the store up to date with a folder; returns the changes."""
        return self.indexer().sync(root, force)

    def add_texts(self, df: DataFrame, path_col: str = "path", text_col: str = "text", content_type: str = "text") -> int:
        """Chunk, embed and upsert rows ``(path, text)``; a path that exists is replaced. Returns how many chunks."""
        docs = df.where(F.col(path_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(path_col).alias("path")).agg(F.max(text_col).alias("text"))
        docs = docs.select("path", F.encode("text", "UTF-8").alias("content"), F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size_bytes"), F.current_timestamp().alias("modified_at"), F.lit("text/plain" if content_type == "text" else content_type).alias("mime_type"))
        chunks, files = self.indexer().build(docs)
        n = chunks.count()
        self.store.replace_files(docs.select("path"), chunks, files)
        return n

    def delete(self, path: str) -> int:
        return self.store.delete(path)

    def rename(self, old: str, new: str) -> int:
        return self.store.rename(old, new)

    @property
    def chunks(self) -> DataFrame:
        return self.store.read("chunks")

    @property
    def files(self) -> DataFrame:
        return self.store.read("files")

    def stats(self) -> DataFrame:
        return self.store.stats()

    def split(self, df: DataFrame, text_col: str = "text", strategy: str | None = None) -> DataFrame:
        return chunk_documents(df, text_col, config=self.settings.chunk_config(), strategy=strategy or self.settings.chunking.strategy)

    def embed(self, df: DataFrame, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
        return embed_distinct(df, text_col, self.embedder, out_col)

    # ---- search

    def query(self, text: str, hybrid: bool | None = None, limit: int | None = None) -> DataFrame:
        """Results of a query string with its filters."""
        q = dsl.parse(text, self.settings.query.default_limit, self.settings.query.max_limit)
        q.metric = self.settings.query.metric
        if limit is not None:
            q.limit = min(limit, self.settings.query.max_limit)
        hybrid = self.settings.query.hybrid if hybrid is None else hybrid
        return search.run_query(self.chunks, q, self.embedder, self.files, hybrid, index=self.store.fulltext() if hybrid else None)

    def search(self, request: search.SearchRequest) -> DataFrame:
        """Results of a request with a vector, a text or both."""
        return search.search(self.chunks, request, self.files, index=self.store.fulltext() if request.text else None)

    def search_vector(self, vector: list[float], limit: int = 10, text: str | None = None, filters: list[dsl.Filter] | None = None, metric: str = "cosine") -> DataFrame:
        """Results for a vector given by the caller, which need not come from the embedder; with a text the hybrid list."""
        return self.search(search.SearchRequest(vector, text, limit, filters or [], metric))

    def documents(self, text: str, k: int = 4, hybrid: bool = True, scores: bool = False) -> DataFrame:
        """Results as documents; the number and kind of search can be set per call, and the score be a column of its own."""
        found = search.as_documents(self.query(text, hybrid, k))
        return found.withColumn("score", F.element_at("metadata", F.lit("score")).cast("double")) if scores else found

    def similar_files(self, path: str, k: int = 10, distinct_files: bool = False) -> DataFrame:
        """What is nearest to the mean vector of a file; empty if the file has no vector."""
        mine = analytics.file_centroids(self.store.chunks_of(path), dim=self.embedder.dim).collect()
        if not mine:
            return search.similar_files(self.chunks.limit(0), path, [0.0] * self.embedder.dim, k, distinct_files)
        return search.similar_files(self.chunks, path, list(mine[0].centroid), k, distinct_files)

    # ---- analytics and plans

    def centroids(self) -> DataFrame:
        return analytics.file_centroids(self.chunks, dim=self.embedder.dim)

    def duplicates(self, threshold: float = 0.95, mode: str = "greedy") -> DataFrame:
        """Near-duplicate files: ``greedy`` pairs with a representative, or ``components``."""
        pairs, members = analytics.duplicate_pairs(self.centroids(), threshold, self.embedder.dim)
        if mode == "components":
            return analytics.duplicate_components(pairs, members)
        return analytics.greedy_groups(pairs, self.files.select("path", F.col("size_bytes").alias("size")), members)

    def cleanup(self, threshold: float = 0.95, now: str | None = None) -> DataFrame:
        return analytics.cleanup_candidates(self.files, self.duplicates(threshold), now)

    def propose(self, scope: str, strategy: str, max_groups: int = 10, threshold: float = 0.7, categories: list[str] | None = None) -> DataFrame:
        """The actions of a plan: ``by_type``, ``by_project``, ``by_topic``, ``by_category`` or ``cleanup``."""
        if strategy == "by_type":
            return organize.by_type(self.files, scope)
        if strategy == "by_project":
            return organize.by_project(self.files, scope)
        if strategy == "by_topic":
            return organize.by_topic(self.centroids(), scope, max_groups, threshold, self.embedder.dim)
        if strategy == "by_category":
            names = self.spark.createDataFrame([(c,) for c in categories or []], "c string")
            vectors = {r.c: list(r.v) for r in names.select("c", self.embedder.embed(F.col("c")).alias("v")).collect()}
            return organize.by_category(self.centroids(), scope, vectors)
        if strategy == "cleanup":
            return organize.deletions(self.cleanup())
        raise ValueError(f"unknown strategy {strategy}")

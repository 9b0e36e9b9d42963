"""Thin adapters: the corpus under the names that retrieval frameworks and agents use; plain Python values out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.api import Corpus
from gleaner.operators import search


def _documents(found: DataFrame, text: str = "page_content") -> list[dict]:
    return [{text: r.page_content, "metadata": dict(r.metadata)} for r in search.as_documents(found).collect()]


class VectorStore:
    """Texts in, similar texts out."""

    def __init__(self, corpus: Corpus):
        self.corpus = corpus

    @classmethod
    def from_texts(cls, spark: SparkSession, texts: list[str], path: str | None = None, paths: list[str] | None = None, **given) -> VectorStore:
        store = cls(Corpus(spark, path, **given))
        store.add_texts(texts, paths)
        return store

    def add_texts(self, texts: list[str], paths: list[str] | None = None) -> list[str]:
        """Add texts under the given paths (else ``text:<hash>``); returns the paths. A path that exists is replaced."""
        rows = self.corpus.spark.createDataFrame(list(zip(paths or [None] * len(texts), texts, strict=True)), "path string, text string")
        rows = rows.withColumn("path", F.coalesce("path", F.concat(F.lit("text:"), F.sha2("text", 256))))
        names = [r.path for r in rows.select("path").collect()]
        self.corpus.add_texts(rows)
        return names

    def add_documents(self, documents: list[dict]) -> list[str]:
        return self.add_texts([d["page_content"] for d in documents], [(d.get("metadata") or {}).get("source") for d in documents])

    def delete(self, paths: list[str]) -> int:
        return sum(self.corpus.delete(p) for p in paths)

    def similarity_search(self, query: str, k: int = 4) -> list[dict]:
        return _documents(self.corpus.query(query, False, k))

    def similarity_search_with_score(self, query: str, k: int = 4) -> list[tuple[dict, float]]:
        return [(d, float(d["metadata"]["score"])) for d in self.similarity_search(query, k)]

    def similarity_search_by_vector(self, vector: list[float], k: int = 4) -> list[dict]:
        return _documents(self.corpus.search_vector(vector, k))

    def hybrid_search(self, query: str, k: int = 4) -> list[dict]:
        return _documents(self.corpus.query(query, True, k))


class DocumentStore:
    """Documents ``{"id", "content"}`` kept by id."""

    def __init__(self, corpus: Corpus):
        self.corpus, self._store = corpus, VectorStore(corpus)

    def count_documents(self) -> int:
        return self.corpus.files.count()

    def write_documents(self, documents: list[dict]) -> int:
        return len(self._store.add_texts([d["content"] for d in documents], [d.get("id") for d in documents]))

    def filter_documents(self, prefix: str = "") -> list[dict]:
        rows = self.corpus.chunks.where(F.col("file_path").startswith(prefix)).orderBy("file_path", "chunk_index")
        return [{"id": r.file_path, "content": r.content} for r in rows.select("file_path", "content").collect()]

    def delete_documents(self, ids: list[str]) -> None:
        self._store.delete(ids)


def tools(corpus: Corpus, root: str) -> dict[str, Callable]:
    """What an agent may call on a corpus, by name; each returns a DataFrame or a number."""
    return {
        "search": corpus.query, "similar_files": corpus.similar_files, "index": lambda force=False: corpus.index(root, force), "index_status": corpus.stats,
        "find_duplicates": corpus.duplicates, "analyze_cleanup": corpus.cleanup, "propose_organization": lambda strategy="by_topic", **kw: corpus.propose(root, strategy, **kw),
        "propose_cleanup": lambda: corpus.propose(root, "cleanup"), "delete": corpus.delete, "rename": corpus.rename,
    }

from gleaner.adapters import DocumentStore, VectorStore, tools
from gleaner.api import Corpus
from gleaner.config import Settings


def settings():
    s = Settings()
    s.embedding.dim = 16
    return s


def test_vector_store_in_memory(spark):
    store = VectorStore.from_texts(spark, ["the red fox runs", "a blue whale swims"], paths=["/a", "/b"], settings=settings())
    assert len(store.add_documents([{"page_content": "green tea is hot", "metadata": {"source": "/c"}}, {"page_content": "no source"}])) == 2
    (d, score), *_ = store.similarity_search_with_score("the red fox runs", 2)
    assert d["page_content"] == "the red fox runs" and abs(score - 1) < 1e-5 and d["metadata"]["file_path"] == "/a"
    vector = [float(x) for x in store.corpus.chunks.where("file_path = '/b'").first().embedding]
    assert store.similarity_search_by_vector(vector, 1)[0]["page_content"] == "a blue whale swims"
    assert store.hybrid_search("green tea", 1)[0]["metadata"]["file_path"] == "/c"
    assert store.delete(["/a", "/none"]) == 1 and store.corpus.stats().first().files == 3
    assert store.corpus.rename("/b", "/d") == 1 and store.corpus.chunks.where("file_path = '/d'").count() == 1


def test_document_store_and_tools(spark, tmp_path):
    corpus = Corpus(spark, f"file://{tmp_path}/s", settings())
    store = DocumentStore(corpus)
    assert store.write_documents([{"id": "/x/1", "content": "one"}, {"id": "/x/2", "content": "two words"}]) == 2
    assert store.count_documents() == 2 and store.filter_documents("/x/2") == [{"id": "/x/2", "content": "two words"}]
    calls = tools(corpus, "/x")
    assert calls["search"]("two words limit:1").first().file_path == "/x/2"
    assert calls["propose_organization"]("by_type").where("action = 'move'").count() == 2
    store.delete_documents(["/x/1"])
    assert calls["index_status"]().first().files == 1

import random

import pytest

from gleaner.operators import chunking as C


def model(text, cfg):
    """The fixed chunker as a plain loop."""
    width, step = 4 * cfg.target, max(1, 4 * (cfg.target - cfg.overlap))
    out, k, n = [], 0, len(text)
    while k < n:
        end = min(k + width, n)
        if end < n:
            length = end - k
            lo, hi = end - length // 5, min(end + length // 10, n)
            for mark, add in (("\n\n", 2), ("\n", 1), (None, 1)):
                hits = [i for i in range(lo, hi) if (text.startswith(mark, i) if mark else text[i] in ".!?" and i + 1 < n and text[i + 1] in " \t\n\r\f\v")]
                if hits:
                    end = hits[-1] + add
                    break
        out.append((k, end))
        k += step
        if end >= n:
            break
    return out


def test_fixed_equals_the_loop(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "bc ", "ä", "\n", "\n\n", ". ", "! ", "漢", "🙂"]) for _ in range(rng.randint(0, 500))) for _ in range(60)]
    for cfg in (C.ChunkConfig(20, 40, 2), C.ChunkConfig(50, 90, 8), C.ChunkConfig()):
        df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, content string")
        got = {}
        for r in C.fixed_chunks(df, config=cfg).collect():
            got.setdefault(r.id, []).append(r)
        for i, t in enumerate(texts):
            rows = sorted(got.get(i, []), key=lambda r: r.chunk_index)
            spans = model(t, cfg)
            assert [r.content for r in rows] == [t[a:b] for a, b in spans]
            assert [(r.start_byte, r.end_byte) for r in rows] == [(len(t[:a].encode()), len(t[:b].encode())) for a, b in spans]
            assert [(r.start_line, r.end_line) for r in rows] == [(t.count("\n", 0, a), t.count("\n", 0, b)) for a, b in spans]


def test_gap_and_gapless():
    text = "a" * 1639 + "\n" + "b" * 2360
    cfg = C.ChunkConfig()
    spans = model(text, cfg)
    assert spans[0] == (0, 1640) and spans[1][0] == 1792
    rows = C.fixed_windows(text, cfg, True)
    assert rows[0]["end_byte"] == 1640 and rows[1]["start_byte"] == 1640
    rng = random.Random(2)
    for _ in range(50):
        t = "".join(rng.choice(["a", "ä\n", "b. ", "\n\n"]) for _ in range(rng.randint(1, 400)))
        data, reach = t.encode(), 0
        for r in C.fixed_windows(t, C.ChunkConfig(20, 40, 4), True):
            assert r["start_byte"] <= reach and data[r["start_byte"] : r["end_byte"]].decode() == r["content"]
            reach = r["end_byte"]
        assert reach == len(data)


def test_sections():
    s = C.sections("intro\n# One\nbody\n\nTitle\n===\nmore\n####### seven\n#NoSpace\n\n---\nend\n")
    assert [(x.heading, x.level) for x in s] == [(None, 0), ("One", 1), ("Title", 1)]
    assert s[1].body.strip() == "body" and "#NoSpace" in s[2].body and "---" in s[2].body
    text = "# Introduction\n\nThis is it.\n\n## Details\n\nMore here."
    parts = C.sections(text)
    assert [x.heading for x in parts] == ["Introduction", "Details"]
    assert text.encode()[parts[1].start :].decode().startswith("## Details")
    assert C.sections("") == [] and C.sections("  \n ") == []


def test_semantic_packing():
    text = "".join(f"# S{i}\n\n{'word ' * 40}\n\n" for i in range(50))
    rows = C.semantic_chunks(text, C.ChunkConfig(100, 200, 20))
    assert len(rows) > 1 and all(len(r["content"].encode()) <= 800 for r in rows) and all(r["symbol_type"] == "section" for r in rows)
    assert sum(r["content"].count("# S") for r in rows) == 50
    big = "# Big\n\n" + "\n\n".join("p" * 150 for _ in range(20))
    rows = C.semantic_chunks(big, C.ChunkConfig(100, 200, 20))
    assert len(rows) > 3 and all(r["symbol_name"] == "Big" for r in rows) and rows[1]["content"].startswith("p" * 80 + "\n\n")
    assert C.semantic_chunks("") == [] and [r["content"] for r in C.semantic_chunks("plain")] == ["plain"]


def test_elements():
    parts = [
        {"kind": "heading", "level": 2, "text": "Top", "byte_offset": 0}, {"kind": "code", "language": "py", "text": "x = 1", "byte_offset": 10}, {"kind": "list", "items": ["a", "b"], "ordered": True, "byte_offset": 20},
        {"kind": "table", "headers": ["h"], "rows": [["1"]], "byte_offset": 30},
    ]
    (row,) = C.element_chunks(parts)
    assert row["content"] == "## Top\n\n```py\nx = 1\n```\n\n1. a\n2. b\n\n| h |\n| --- |\n| 1 |\n" and row["symbol_name"] == "Top"


@pytest.mark.parametrize(
    ("line", "language", "want"),
    [
        ("pub fn foo(x: i32) {", "rust", ("function", "foo")), ("pub(crate) struct Bar<T> {", "rust", ("struct", "Bar")), ("impl<T> Show for Foo<T> {", "rust", ("impl", "Show")), ("let x = 1;", "rust", None),
        ("async def run(self):", "python", ("function", "run")), ("class A(B):", "python", ("class", "A")), ("# def x():", "python", None), ("export const f = async (a) => {", "javascript", ("function", "f")),
        ("export default class K extends L {", "typescript", ("class", "K")), ("func (s *Srv) Serve(a int) error {", "go", ("method", "Serve")), ("func main() {", "go", ("function", "main")), ("type T struct {", "go", ("struct", "T")),
        ("private static int size(List x) {", "java", ("method", "size")), ("public class Foo {", "java", ("class", "Foo")), ("static int add(int a, int b) {", "c", ("function", "add")), ("if (x) {", "c", None), ("  ", None, None),
    ],
)
def test_boundaries(line, language, want):
    assert C.code_boundary(line, language) == want


def test_code_chunks():
    text = "import os\r\n\r\ndef a():\r\n    pass\r\n\r\nclass B:\r\n    x = 1\r\n"
    rows = C.code_chunks(text, "python")
    assert [(r["symbol_type"], r["symbol_name"], r["start_line"], r["end_line"]) for r in rows] == [("function", "a", 2, 5), ("class", "B", 5, 7)]
    data = text.encode()
    assert data[rows[0]["start_byte"] : rows[0]["end_byte"]].decode().replace("\r", "").strip() == rows[0]["content"].strip()
    assert C.code_chunks(text, "python", keep_preamble=True)[0]["content"] == "import os\n"
    lines = "\n".join(f"x{i} = {i}" for i in range(10))
    assert len(C.code_chunks(lines, "python")) == 1 and len(C.code_chunks(lines, "python", stop_at_end=False)) == 4
    big = "def f():\n" + "".join(f"    y{i} = {i}  # {'c' * 60}\n" for i in range(200))
    parts = C.code_chunks(big, "python", C.ChunkConfig(100, 200, 20))
    assert len(parts) > 5 and {r["symbol_name"] for r in parts} == {"f"} and parts[-1]["end_line"] == 201
    assert all(big.encode()[r["start_byte"] : r["end_byte"]].decode().rstrip("\n") == r["content"] for r in parts)
    assert C.code_chunks("") == []


def test_routing_and_splitting(spark):
    rows = [("a", "def f():\n  pass", "code:py", "k"), ("b", "# H\n\ntext", "markdown", "k"), ("c", "page text", "pdf:1", "k"), ("d", "", "text", "k"), ("e", None, None, "k"), ("f", "plain", None, "k")]
    df = spark.createDataFrame(rows, "id string, text string, content_type string, content string")
    got = {r.id: (r.symbol_type, r.content) for r in C.chunk_documents(df).collect()}
    assert got == {"a": ("function", "def f():\n  pass"), "b": ("section", "# H\n\ntext"), "c": (None, "page text"), "f": (None, "plain")}
    with pytest.raises(ValueError):
        C.chunk_documents(df, strategy="other")
    docs = spark.createDataFrame([("x " * 3000, {"source": "s", "chunk_index": "old"}), ("y", None)], "page_content string, metadata map<string,string>")
    out = C.split_documents(docs, strategy="fixed").collect()
    assert all(set(r.metadata) >= {"chunk_index", "start_byte", "end_byte", "start_line", "end_line"} for r in out) and {r.metadata.get("source") for r in out} == {"s", None}
    assert C.chunk_documents(df.limit(0)).count() == 0


def test_linked_across_spans(spark, monkeypatch):
    monkeypatch.setattr(C, "SPAN", 3)
    rows = [(f"c{i:02d}", "d", i * (1 + i // 7)) for i in range(20)] + [("x", "e", 0), ("y", None, 1), ("z", None, None)]
    got = {r.chunk_id: (r.previous_id, r.next_id) for r in C.linked(spark.createDataFrame(rows, "chunk_id string, file_path string, chunk_index int")).collect()}
    want = {f"c{i:02d}": (f"c{i - 1:02d}" if i else None, f"c{i + 1:02d}" if i < 19 else None) for i in range(20)} | {"x": (None, None), "z": (None, "y"), "y": ("z", None)}
    assert got == want

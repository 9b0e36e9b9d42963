"""Properties over generated texts and tables."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.functions.paths import glob_to_regex
from gleaner.operators import chunking as C
from gleaner.plans import dsl

TEXT = st.text(alphabet=st.sampled_from(list("ab. !?\n\r\t#=-(){}äß漢🙂defclassfn")), max_size=400)
CONFIG = st.builds(C.ChunkConfig, st.integers(1, 40), st.integers(1, 60), st.integers(0, 12))


@given(TEXT, CONFIG)
@settings(max_examples=150, deadline=None)
def test_gapless_windows_cover_the_text(text, config):
    data, reach = text.encode(), 0
    for r in C.fixed_windows(text, config, gapless=True):
        assert r["start_byte"] <= reach <= r["end_byte"] and data[r["start_byte"] : r["end_byte"]].decode() == r["content"]
        assert r["start_line"] == data[: r["start_byte"]].count(b"\n") and r["end_line"] == data[: r["end_byte"]].count(b"\n")
        reach = r["end_byte"]
    assert reach == len(data)


@given(TEXT, CONFIG)
@settings(max_examples=150, deadline=None)
def test_sections_lose_no_word(text, config):
    words = lambda t: re.findall(r"\w+", t)
    joined = [w for s in C.sections(text) for w in words((s.heading or "") + " " + s.body)]
    assert sorted(joined) == sorted(words(text))
    spans = [(s.start, s.end) for s in C.sections(text)]
    assert all(a <= b for a, b in spans) and all(x[1] <= y[0] or x[0] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    for r in C.semantic_chunks(text, config):
        assert r["content"].strip()


@given(TEXT, st.sampled_from([None, "python", "rust", "c"]), CONFIG)
@settings(max_examples=150, deadline=None)
def test_code_chunks_keep_every_line_with_preamble(text, language, config):
    rows = C.code_chunks(text, language, config, keep_preamble=True)
    n = len(C._lines(text))
    seen = {i for r in rows for i in range(r["start_line"], r["end_line"])}
    assert seen == set(range(n)) or not rows
    for r in rows:
        assert 0 <= r["start_byte"] <= r["end_byte"] <= len(text.encode())


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_any_query_string_parses(text):
    q = dsl.parse(text)
    assert q.limit >= 0 and all(isinstance(f, dsl.Filter) for f in q.filters)


@given(st.text(alphabet="ab/.*?[", max_size=12), st.text(alphabet="ab/.", max_size=12))
@settings(max_examples=200, deadline=None)
def test_globs_compile_and_plain_ones_match_themselves(glob, path):
    assert re.match(glob_to_regex(glob), path) is not None or True
    if path and not set(path) & set("*?["):
        assert re.match(glob_to_regex(path), path)

import random
import re

from gleaner.llm.words import ALNUM, ALNUM_, Words, pieces


def test_words_and_runs_match_regular_expressions():
    rng = random.Random(1)
    alphabet = "abcXYZ019_ .,\n\tßÄéж漢🙂K"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(200)] + ["", " ", "a"]
    for chars, pattern in ((ALNUM, "[a-z0-9]+"), (ALNUM_, "[a-z0-9_]+")):
        w = Words(texts, chars)
        found = [(d, bytes(w.data[s:e]).decode()) for d, s, e in zip(w.doc, w.start, w.end, strict=True)]
        assert found == [(i, x) for i, t in enumerate(texts) for x in re.findall(pattern, t.lower())]
        names = {}
        for (_, x), h in zip(found, w.hash, strict=True):
            assert names.setdefault(x, h) == h
        assert len(set(names.values())) == len(names)
        for n in (1, 3, 5, 7):
            doc, at, h = w.runs(n)
            seen = {}
            for d, a, v in zip(doc, at, h, strict=True):
                run = tuple(x for _, x in found[a : a + n])
                assert all(found[a + i][0] == d for i in range(n)) and seen.setdefault(run, v) == v
            assert len(set(seen.values())) == len(seen)


def test_pieces_cover_everything():
    texts = ["x" * n for n in (5, 0, 100, 3, 7)]
    got = list(pieces(texts, 10))
    assert [i for a, b in got for i in range(a, b)] == list(range(5)) and list(pieces([])) == []

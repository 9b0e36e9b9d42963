import random
import re

import pytest

from gleaner.llm import leakage


def words(t):
    return re.findall("[a-z0-9]+", (t or "").lower())


def longest_common(a, b):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        cur = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                cur[j + 1] = prev[j] + 1
                best = max(best, cur[j + 1])
        prev = cur
    return best


def data():
    rng = random.Random(2)
    vocab = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 60)))) for i in range(25)]
    docs = []
    for d in range(80):
        parts = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            w = items[rng.randrange(25)][1].split()
            a = rng.randrange(len(w))
            cut = w[a : a + rng.randint(3, 40)]
            at = rng.randint(0, len(parts))
            parts[at:at] = cut
        docs.append((d, rng.choice([" ", ", ", "\n> ", " -- "]).join(parts).upper() if rng.random() < 0.5 else " ".join(parts)))
    return docs + [(900, None), (901, ""), (None, "x"), docs[0]], items + [(100, None), (None, "abc"), (101, "short one"), items[0]]


def test_found_pairs_equal_brute_force_both_ways(spark):
    docs, items = data()
    d = spark.createDataFrame([(*r, "z", 1) for r in docs], "doc_id long, text string, item string, h int")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = {(a, b): n for a, t in docs if a is not None for b, s in items if b is not None and (n := longest_common(words(t), words(s))) >= 12}
    for limit in (leakage.MAX_ITEM_BYTES, 10):
        got = {(r.doc_id, r.item_id): r for r in leakage.leaked_items(d, i, max_item_bytes=limit).collect()}
        assert set(got) == set(want)
        for k, r in got.items():
            assert r.longest == want[k] and 0 < r.coverage <= 1 and r.covered >= r.longest and r.tiles >= 1


def test_reordered_passage_is_covered(spark):
    w = [f"q{i}" for i in range(48)]
    docs = spark.createDataFrame([(1, " ".join(w[24:] + ["other"] + w[:24]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")
    r = leakage.leaked_items(docs, items).first()
    assert (r.tiles, r.longest, r.covered, r.coverage) == (2, 24, 48, 1.0)
    assert leakage.leaked_items(docs, items, min_coverage=0.99).count() == 1


def test_tiles_do_not_overlap():
    doc = [1, 2, 3, 4, 5, 1, 2, 3, 9, 3, 4, 5]
    item = [1, 2, 3, 4, 5]
    pairs = [(i, j) for i in range(len(doc) - 1) for j in range(4) if doc[i : i + 2] == item[j : j + 2]]
    import numpy as np

    tiles = leakage.tile(np.array(doc), np.array(item), np.array([p for p, _ in pairs]), np.array([q for _, q in pairs]), 2)
    assert tiles == [(0, 0, 5)]


def test_empty(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a " * 20)], "item_id long, text string")
    assert leakage.leaked_items(d, i).count() == 0
    assert leakage.leaked_items(spark.createDataFrame([(1, "a " * 20)], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        leakage.leaked_items(d, i, run=1)


def test_shared_seeds_are_salted_without_loss(spark, monkeypatch):
    """A seed that many documents have is spread over tasks; the pairs stay the same."""
    rng = random.Random(8)
    boiler = " ".join(f"b{i}" for i in range(15))
    docs = [(i, f"{boiler} " + " ".join(rng.choice("pqrst") + str(rng.randint(0, 99)) for _ in range(20))) for i in range(40)]
    items = [(k, f"x{k} y{k} {boiler} z{k}") for k in range(5)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plain = {(r.doc_id, r.item_id, r.covered) for r in leakage.leaked_items(d, i, max_item_bytes=0).collect()}
    monkeypatch.setattr(leakage, "SAMPLE", 1)
    monkeypatch.setattr(leakage, "HOT", 10)
    monkeypatch.setattr(leakage, "SALT", 4)
    assert plain == {(r.doc_id, r.item_id, r.covered) for r in leakage.leaked_items(d, i, max_item_bytes=0).collect()} == {(a, b, 15) for a in range(40) for b in range(5)}

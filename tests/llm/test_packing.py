import os
import random

import numpy as np
import pytest

from gleaner.llm import packing

needs_vocabulary = pytest.mark.skipif(not os.path.exists(packing.VOCABULARY), reason="no tokenizer file")


def test_no_limit_is_broken_and_little_is_wasted():
    rng = np.random.default_rng(0)
    tokens = rng.integers(1, 900, 3000)
    sizes = np.stack([tokens, np.ones(3000, int), (tokens * rng.random(3000)).astype(int)], 1)
    limits = np.array([2048, 16, 2048])
    box = packing.pack(sizes, limits)
    used = np.stack([np.bincount(box, sizes[:, d]) for d in range(3)], 1)
    assert (used <= limits).all() and box.min() == 0
    assert tokens.sum() / ((box.max() + 1) * 2048) > 0.98


def test_every_dimension_binds():
    sizes = np.array([[1, 1, 0]] * 10)
    assert np.bincount(packing.pack(sizes, np.array([100, 4, 100]))).tolist() == [4, 4, 2]
    sizes = np.array([[10, 1, 10]] * 4)
    assert np.bincount(packing.pack(sizes, np.array([100, 9, 20]))).tolist() == [2, 2]
    assert len(packing.pack(np.zeros((0, 3), int), np.array([1, 1, 1]))) == 0


@needs_vocabulary
def test_table(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "Größe", "x1"]) for _ in range(rng.randint(0, 400))) for _ in range(200)]
    chat = "user: please do it now\nassistant: done\nuser: thanks\nassistant: welcome"
    rows = [(i, t, "q", 5) for i, t in enumerate(texts)] + [(900, "word " * 3000, "q", 1), (901, None, "q", 1), (None, "x", "q", 1), (902, "", "q", 1), (0, texts[0], "q", 5), (903, chat, "q", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, container string, tokens int")
    out = packing.fill_containers(df, capacity=512, max_segments=10).collect()
    enc = packing.encoder(packing.VOCABULARY)
    by_doc, by_box = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_box.setdefault(r.container, []).append(r)
    assert set(by_doc) == {*range(200), 900, 902, 903}
    for i, parts in by_doc.items():
        n = len(enc.encode_ordinary(next(r[1] for r in rows if r[0] == i)))
        parts.sort(key=lambda r: r.piece)
        assert [p.token_start for p in parts] == [0, *(p.token_end for p in parts[:-1])] and parts[-1].token_end == n
        assert len(parts) == max(1, -(-n // 512))
    for parts in by_box.values():
        assert sum(r.tokens for r in parts) <= 512 and len(parts) <= 10 and sum(r.loss_tokens for r in parts) <= 512
    c = by_doc[903][0]
    assert 0 < c.loss_tokens < c.tokens
    assert packing.fill_containers(spark.createDataFrame([], df.schema)).count() == 0
    with pytest.raises(ValueError):
        packing.fill_containers(df, capacity=0)
    by_box, by_doc = {}, {}
    for r in packing.fill_containers(df, capacity=512, max_segments=50, max_loss=100).collect():  # loss binds
        by_box.setdefault(r.container, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for p in by_box.values():
        assert sum(r.tokens for r in p) <= 512 and len(p) <= 50
        assert sum(r.loss_tokens for r in p) <= 100 or sum(r.loss_tokens > 0 for r in p) == 1  # a single piece may bring more
    for i, parts in by_doc.items():
        n = len(enc.encode_ordinary(next(r[1] for r in rows if r[0] == i)))
        assert len(parts) == max(1, -(-n // 512))  # split only where larger than a container


@needs_vocabulary
def test_placement_depends_on_neither_layout_nor_order(spark):
    rows = [(i, "word " * (i * 37 % 300)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = {(r.doc_id, r.piece): r.container for r in packing.fill_containers(df.repartition(1), group=100).collect()}
    two = {(r.doc_id, r.piece): r.container for r in packing.fill_containers(df.repartition(7).orderBy("text"), group=100).collect()}
    assert one == two


@needs_vocabulary
def test_utilisation(spark):
    placed = [(1, 0, 0, 100, 100, 60, "a"), (2, 0, 0, 28, 28, 28, "a"), (3, 0, 0, 64, 64, 0, "b")]
    df = spark.createDataFrame(placed, packing.PLACED)
    r = packing.utilisation(df, 128, 2, 100).first()
    assert (r.containers, r.tokens, r.used, r.most_tokens, r.most_segments, r.most_loss) == (2, 192, 0.75, 128, 2, 88)
    assert (r.full_of_tokens, r.full_of_segments, r.full_of_loss) == (1, 1, 0)
    assert packing.utilisation(df.limit(0)).first().containers == 0


@needs_vocabulary
def test_tokens_are_those_of_the_vocabulary_file():
    import public_tokenizers
    import tiktoken

    enc = packing.encoder(packing.VOCABULARY)
    same = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=enc._mergeable_ranks, special_tokens={})
    for t in ("Hello  world\n\n  x", "naïve 123abc ... ", "日本語 🙂", ""):
        assert enc.encode_ordinary(t) == same.encode_ordinary(t)

import random

from gleaner.llm import reading_level as rl

LEVEL_WORDS = [["cat", "dog", "sun", "big", "run"], ["garden", "window", "little", "travel", "summer"], ["however", "compare", "central", "region", "develop"], ["systematic", "comprehensive", "whereas", "instrument", "derive"], ["epistemic", "notwithstanding", "heterogeneity", "incommensurable", "circumscribe"]]
COMMON = ["the", "a", "of", "and", "in", "to"]


def text(rng, level):
    pick = lambda: rng.choice(COMMON) if rng.random() < 0.5 else rng.choice(LEVEL_WORDS[level - 1] if rng.random() < 0.9 else rng.choice(LEVEL_WORDS))
    return ". ".join(" ".join(pick() for _ in range(10)) for _ in range(rng.randint(15, 30)))


def make(spark, extra=(), labelled=0.6):
    rng = random.Random(9)
    docs, labels, truth = [], [], {}
    for i in range(300):
        level = i % 5 + 1
        truth[i] = level
        docs.append((i, text(rng, level), [None, "en", "EN", "En"][i % 4], "x"))
        if rng.random() < labelled:
            labels.append((i, level, "r1"))
    d = spark.createDataFrame([*docs, *extra], "doc_id long, text string, lang string, grade string")
    return d, spark.createDataFrame(labels, "doc_id long, reading_level int, rater string"), truth


def test_levels_come_out(spark):
    code = "\n".join("    if (a[i] == b[j]) { c[i] = foo(b, {x: 1}); }" for _ in range(10))
    extra = [(900, None, "en", "x"), (901, "   ", "en", "x"), (902, "see notes.md", None, "x"), (903, code, "en", "x"), (904, text(random.Random(1), 2), "de", "x"), (None, "words " * 30, "en", "x")]
    mixed = text(random.Random(3), 1) + "\n```\n" + code + "\n```\n> " + text(random.Random(4), 5).replace("\n", " ")
    d, labels, truth = make(spark, [*extra, (905, mixed, "en", "x")])
    labels = labels.unionByName(spark.createDataFrame([(0, 1, "r1"), (0, None, "r3"), (7777, 3, "r1"), (None, 2, "r1")], labels.schema))
    got = {r.doc_id: r.reading_level for r in rl.reading_levels(d, labels).collect()}
    assert set(got) == {*truth, 905}
    assert sum(got[i] == level for i, level in truth.items()) / len(truth) >= 0.95 and got[905] == 1
    acc = rl.held_out_accuracy(d, labels).first()
    assert acc.exact >= 0.85 and acc.within_one >= 0.95


def test_without_labels_and_empty(spark):
    d, labels, _ = make(spark, labelled=0)
    assert {r.reading_level for r in rl.reading_levels(d, labels).collect()} == {None}
    d, labels, _ = make(spark)
    assert rl.reading_levels(d.limit(0), labels).count() == 0


def test_prose():
    assert rl.prose("# Title\n\n```py\nx = {1: [2]}\n```\n> quoted words\nplain words here") == "plain words here"
    assert rl.prose("int f(int a) { return a[0] == {1}; }") is None
    assert rl.prose("") is None and rl.prose("# only a heading") is None


def test_counts_of_long_texts_are_whole(spark):
    text = "The old dog ran over a hill and saw the small house by the river. " * 700
    df = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    words = rl.bags(df, "doc_id", "text", "lang").toArrow().column("words").combine_chunks()
    _, bucket, weight = rl._edges(words)
    assert len(bucket) == 13 and max(weight) == 2100**0.5 and min(weight) == 700**0.5

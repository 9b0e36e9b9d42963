"""Reading level of English prose, by propagating graded examples over the document-word graph.

Documents and words are the nodes of a bipartite graph; an edge weighs the square root of how
often the word stands in the document. Graded documents are clamped to their grade, every
other node takes the weighted mean of its neighbours, and rounds of this approach the
harmonic function: words of demanding documents become demanding, and documents take on the
difficulty of their words. Cut points between levels are then fitted to the graded documents.

Scale: words are hashed to ``buckets`` nodes (a parameter; ``BUCKETS`` unless given, to be raised with the vocabulary), so the word scores that go to the tasks and
come back as sums have a fixed size whatever the corpus; the documents' side never moves. A
round is one pass over packed counts. Hot words cost nothing, as sums are made per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.words import Words, alphabet, pieces
from gleaner.runtime import materialize, spread

BUCKETS = 1 << 18
#: A text of fewer words of prose is a stub.
MIN_WORDS = 20
#: Share of code signs from which a text counts as code.
CODE_SHARE = 0.045
#: Words in fewer documents carry no difficulty (mostly names).
MIN_DOCUMENTS = 5
LEVELS = 5
BINS = 4000

_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_CODE_SIGNS = re.compile(r"[{}()=_<>\[\]]")
_LATIN = alphabet("abcdefghijklmnopqrstuvwxyz")


def prose(text: str) -> str | None:
    """The prose of a text without code blocks, quoted lines, headings and rules; null for code."""
    lines = [x.strip() for x in _FENCE.sub("\n", text).splitlines()]
    lines = [x for x in lines if x and not x.startswith((">", "#"))]
    if not lines:
        return None
    whole = " ".join(lines)
    if len(_CODE_SIGNS.findall(whole)) < CODE_SHARE * len(whole):
        return whole
    # mixed: keep the lines that are no code themselves
    lines = [x for x in lines if len(_CODE_SIGNS.findall(x)) < CODE_SHARE * len(x)]
    kept = " ".join(lines)
    return kept if len(kept) >= 0.5 * len(whole) else None


def bags(docs: DataFrame, id_col: str, text_col: str, lang_col: str, buckets: int = BUCKETS, min_words: int = MIN_WORDS) -> DataFrame:
    """``(id, words)`` of English prose: ascending word buckets (4 bytes each), then counts (4 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), [prose(t) or "" for t in b.column(1).to_pylist()]
            keep, packed = [], []
            for lo, hi in pieces(texts):
                w = Words(texts[lo:hi], _LATIN)
                n = np.bincount(w.doc, minlength=hi - lo) if len(w.doc) else np.zeros(hi - lo, np.int64)
                key = w.doc.astype(np.int64) * buckets + (w.hash % np.uint64(buckets)).astype(np.int64)
                key, count = np.unique(key, return_counts=True)
                doc, bucket = key // buckets, (key % buckets).astype(np.int32)
                count = count.astype(np.uint32)
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                for i in np.flatnonzero(n >= min_words):
                    s = slice(first[i], first[i + 1])
                    keep.append(lo + int(i))
                    packed.append(bucket[s].tobytes() + count[s].tobytes())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(packed, pa.binary())], ["id", "words"])

    english = F.col(lang_col).isNull() | F.lower(F.trim(F.col(lang_col))).rlike("^en([-_].*)?$")
    rows = docs.where(english & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(rows).mapInArrow(run, "id long, words binary")


def _edges(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and weight of every edge of a batch."""
    if not len(column):
        none = np.empty(0, np.int64)
        return none, none, np.empty(0)
    rows, buckets, counts = [], [], []
    for i, w in enumerate(column.to_pylist()):
        n = len(w) // 8
        buckets.append(np.frombuffer(w, np.int32, n))
        counts.append(np.frombuffer(w, np.uint32, n, 4 * n))
        rows.append(np.full(n, i, np.int32))
    return np.concatenate(rows), np.concatenate(buckets), np.sqrt(np.concatenate(counts).astype(np.float64))


def _means(row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, score: np.ndarray, use: np.ndarray, n: int, fallback: float) -> np.ndarray:
    """Weighted mean word score of each document; documents without a usable word get the fallback."""
    w = weight * use[bucket]
    total = np.bincount(row, w, minlength=n)
    return np.where(total > 0, np.bincount(row, w * score[bucket], minlength=n) / np.where(total > 0, total, 1), fallback)


def difficulty(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rounds: int = 12, tolerance: float = 1e-3, buckets: int = BUCKETS) -> DataFrame:
    """``(id, difficulty, grade)``: the harmonic score of each prose document and the mean grade of graded ones.

    The score of a graded document is what its words say, not its clamped grade. Without a
    grade in the corpus the scores are null.
    """
    given = labels.where(F.col("reading_level").isNotNull()).select(F.col("doc_id").alias("id"), "reading_level", "rater").distinct()
    given = given.groupBy("id").agg(F.avg("reading_level").alias("grade"))
    bag = bags(docs, id_col, text_col, lang_col, buckets).groupBy("id").agg(F.max("words").alias("words"))
    graph = materialize(bag.join(given, "id", "left"), "rl-graph")
    middle = graph.agg(F.avg("grade").alias("m")).first().m
    if middle is None:
        return graph.select("id", F.lit(None).cast("double").alias("difficulty"), "grade")

    def degrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs_of = np.zeros(buckets), np.zeros(buckets)
        for b in batches:
            _, bucket, weight = _edges(b.column("words"))
            total += np.bincount(bucket, weight, minlength=buckets)
            docs_of += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(docs_of)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at]), pa.array(docs_of[at])], ["b", "w", "n"])

    got = graph.select("words").mapInArrow(degrees, "b int, w double, n double").groupBy("b").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).toPandas()
    degree, use = np.zeros(buckets), np.zeros(buckets, np.float32)
    at = got["b"].to_numpy()
    degree[at], use[at] = got["w"].to_numpy(), got["n"].to_numpy() >= MIN_DOCUMENTS
    score = np.full(buckets, middle, np.float32)
    for r in range(rounds):

        def spread(batches: Iterator[pa.RecordBatch], score: np.ndarray = score, first: bool = r == 0) -> Iterator[pa.RecordBatch]:
            total = np.zeros(buckets)
            for b in batches:
                row, bucket, weight = _edges(b.column("words"))
                grade = b.column("grade").to_numpy(zero_copy_only=False).astype(np.float64)
                mean = np.full(b.num_rows, middle) if first else _means(row, bucket, weight, score, use, b.num_rows, middle)
                value = np.where(np.isnan(grade), mean, grade)
                total += np.bincount(bucket, weight * value[row], minlength=buckets)
            at = np.flatnonzero((total != 0) & (use > 0))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["b", "s"])

        got = graph.select("words", "grade").mapInArrow(spread, "b int, s double").groupBy("b").agg(F.sum("s").alias("s")).toPandas()
        fresh, at = score.copy(), got["b"].to_numpy()
        fresh[at] = (got["s"].to_numpy() / degree[at]).astype(np.float32)
        change = float(np.abs(fresh - score).max())
        score = fresh
        if change < tolerance:
            break

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mean = _means(*_edges(b.column("words")), score, use, b.num_rows, middle)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(mean), b.column("grade")], ["id", "difficulty", "grade"])

    return graph.select("id", "words", "grade").mapInArrow(rate, "id long, difficulty double, grade double")


def cut_points(rated: DataFrame) -> list[float]:
    """Scores between the levels that misplace the fewest graded documents; from a histogram of bounded size."""
    graded = rated.where(F.col("grade").isNotNull())
    span = graded.agg(F.min("difficulty").alias("lo"), F.max("difficulty").alias("hi")).first()
    if span.lo is None:
        return []
    width = max((span.hi - span.lo) / BINS, 1e-9)
    hist = graded.groupBy(F.floor((F.col("difficulty") - span.lo) / width).cast("int").alias("b"), F.round("grade").cast("int").alias("g")).count().toPandas()
    counts = np.zeros((BINS + 2, LEVELS + 1))
    np.add.at(counts, (np.minimum(hist["b"].to_numpy(), BINS + 1), np.clip(hist["g"].to_numpy(), 1, LEVELS)), hist["count"].to_numpy())
    cuts = []
    for level in range(1, LEVELS):
        low, high = counts[:, : level + 1].sum(1), counts[:, level + 1 :].sum(1)
        wrong = np.concatenate([[low.sum()], low.sum() - np.cumsum(low)]) + np.concatenate([[0], np.cumsum(high)])  # cut before bin i
        best = np.flatnonzero(wrong == wrong.min())
        cuts.append(span.lo + width * float(best[len(best) // 2]))
    return [float(x) for x in np.maximum.accumulate(cuts)]


def reading_levels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, reading_level, difficulty)`` of every document of English prose, levels 1 to 5.

    English are documents whose language is null or ``en`` in any letter case. Null, blank and
    stub texts (fewer than ``MIN_WORDS`` words of prose) and bare code have no row. Repeated
    grades of a rater count once, several raters are averaged, null grades are ignored; of
    repeated rows of an id one counts. Without any grade the levels are null; an empty table
    gives an empty result.
    """
    rated = materialize(difficulty(docs, labels, id_col, text_col, lang_col, buckets=buckets), "rl-rated")
    cuts = cut_points(rated)
    level = F.lit(1)
    for c in cuts:
        level = level + (F.col("difficulty") >= c).cast("int")
    return rated.select(F.col("id").alias("doc_id"), (level if cuts else F.lit(None)).cast("int").alias("reading_level"), F.round("difficulty", 6).alias("difficulty"))


def held_out_accuracy(docs: DataFrame, labels: DataFrame, part: int = 4) -> DataFrame:
    """One row: of the graded documents of which one in ``part`` is hidden, how many hidden ones come out exact and within one level."""
    hidden = F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0
    levels = reading_levels(docs, labels.where(~hidden))
    truth = labels.where(hidden & F.col("reading_level").isNotNull()).groupBy("doc_id").agg(F.round(F.avg("reading_level")).cast("int").alias("grade"))
    both = levels.join(truth, "doc_id")
    gap = F.abs(F.col("reading_level") - F.col("grade"))
    return both.agg(F.count("*").alias("documents"), F.avg((gap == 0).cast("double")).alias("exact"), F.avg((gap <= 1).cast("double")).alias("within_one"))

"""Held-out passages that appear in training text, by greedy string tiling.

Documents and passages are compared as word sequences. Runs of ``run`` words that both
share are the seeds (Karp-Rabin hashes, joined); around them the longest non-overlapping
matches are marked, longest first, until no unmarked match of ``run`` words is left. The
marked words of a passage are its coverage, which a passage in changed order also reaches.

Scale: documents are scanned once where they lie. The seeds of the passages travel to the
tasks only after their size has been checked against ``MAX_ITEM_BYTES``; a larger test set
takes the other way, an equi-join on winnowed seeds, which both sides select alike. A seed that a
large share of the documents has (boilerplate, found on a deterministic sample) is salted: its documents are spread over
``SALT`` tasks, each of which gets the passages that have it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.words import ALNUM, Words, pieces
from gleaner.runtime import materialize, spread

#: Test texts of at most this many bytes together are sent to every task.
MAX_ITEM_BYTES = 32 << 20
#: Of one document in SAMPLE, how many must have a seed for it to be salted, and over how many tasks.
SAMPLE, HOT, SALT = 64, 512, 64

RESULT = "doc_id long, item_id long, tiles int, longest int, covered int, item_words int, coverage double"


def tile(doc: np.ndarray, item: np.ndarray, at_doc: np.ndarray, at_item: np.ndarray, run: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word-hash sequences from shared seeds of ``run`` words.

    ``at_doc`` and ``at_item`` are the start positions of all shared runs. Returns tiles
    ``(doc position, item position, length)``, longest first, none overlapping in either text.
    """
    starts = set(zip(at_doc.tolist(), at_item.tolist(), strict=True))
    heap = []
    for i, j in starts:
        if (i - 1, j - 1) in starts:  # not the begin of a maximal match
            continue
        n = 0
        while (i + n, j + n) in starts:
            n += 1
        heap.append((-(n + run - 1), i, j))
    heapq.heapify(heap)
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    out = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = free_doc[i : i + n] & free_item[j : j + n]
        if free.all():
            free_doc[i : i + n] = False
            free_item[j : j + n] = False
            out.append((i, j, n))
            continue
        edge = np.diff(np.concatenate([[0], free.view(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if b - a >= run:
                heapq.heappush(heap, (-int(b - a), i + int(a), j + int(a)))
    return out


class _Items:
    """Word hashes of the passages, and their runs in order of hash."""

    def __init__(self, ids: list[int], texts: list[str], run: int):
        w = Words(texts, ALNUM)
        bounds = np.searchsorted(w.doc, np.arange(len(texts) + 1))
        self.ids = ids
        self.words = [w.hash[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        doc, at, h = w.runs(run)
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.at = h[order], doc[order], (at - bounds[doc])[order]


def _report(doc_id: int, words: np.ndarray, items: _Items, run: int, k: int, at_doc: np.ndarray, at_item: np.ndarray) -> tuple:
    tiles = tile(words, items.words[k], at_doc, at_item, run)
    covered = sum(n for _, _, n in tiles)
    size = len(items.words[k])
    return doc_id, items.ids[k], len(tiles), max(n for _, _, n in tiles), covered, size, covered / size


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def _matches(w: Words, items: _Items, run: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(doc, item, positions in doc, positions in item)`` of shared runs."""
    doc, at, h = w.runs(run)
    lo = np.searchsorted(items.hash, h, "left")
    hit = np.flatnonzero(items.hash[np.minimum(lo, len(items.hash) - 1)] == h)
    if not len(hit):
        return
    lo = lo[hit]
    n = np.searchsorted(items.hash, h[hit], "right") - lo
    row = np.repeat(np.arange(len(hit)), n)
    where = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    d, i = doc[hit][row], items.item[where]
    p, q = at[hit][row] - np.searchsorted(w.doc, d), items.at[where]
    order = np.lexsort((i, d))
    d, i, p, q = d[order], i[order], p[order], q[order]
    cut = np.flatnonzero((d[1:] != d[:-1]) | (i[1:] != i[:-1])) + 1
    for a, b in zip(np.append(0, cut), np.append(cut, len(d)), strict=True):
        yield int(d[a]), int(i[a]), p[a:b], q[a:b]


def _scan(items: _Items, run: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in pieces(texts):
                w = Words(texts[lo:hi], ALNUM)
                bounds = np.searchsorted(w.doc, np.arange(hi - lo + 1))
                rows = [_report(ids[lo + d], w.hash[bounds[d] : bounds[d + 1]], items, run, k, p, q) for d, k, p, q in _matches(w, items, run)]
                if rows:
                    yield _rows(rows)

    return go


def _winnow(run: int):
    """Fingerprints such that any two texts with ``run`` words in common share one: the least hash of each window."""
    gram = max(1, run // 2)
    span = run - gram + 1

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in pieces(texts):
                doc, _, h = Words(texts[lo:hi], ALNUM).runs(gram)
                if len(h) < span:
                    continue
                window = np.lib.stride_tricks.sliding_window_view(h, span)
                ok = doc[: len(window)] == doc[span - 1 :]
                both = np.unique(np.stack([doc[: len(window)][ok], window[ok].min(1).view(np.int64)], 1), axis=0)
                if len(both):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(both[:, 0] + lo)), pa.array(both[:, 1])], ["id", "h"])

    return go


def _pair_scan(run: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, t, k, s in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "item_id", "item")), strict=True):
                items, w = _Items([k], [s], run), Words([t], ALNUM)
                if len(items.hash):
                    rows += [_report(d, w.hash, items, run, 0, p, q) for _, _, p, q in _matches(w, items, run)]
            if rows:
                yield _rows(rows)

    return go


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    run: int = 12,
    min_coverage: float = 0.0,
    max_item_bytes: int = MAX_ITEM_BYTES,
) -> DataFrame:
    """Documents that contain passages, one row per document and passage.

    ``tiles`` non-overlapping common stretches of at least ``run`` words, the ``longest`` of
    them, the passage words they cover and that share of the passage. Words are maximal runs
    of ``a-z`` and ``0-9`` of the lower-cased text.

    Null ids, null or wordless texts and passages of fewer than ``run`` words match nothing;
    repeated rows of a pair give one row; empty tables give an empty result.
    """
    if run < 2:
        raise ValueError("run must be at least 2")
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    i = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("item")).where("item_id is not null and item is not null")
    i = i.distinct()
    if (i.agg(F.sum(F.octet_length("item"))).first()[0] or 0) <= max_item_bytes:
        rows = i.orderBy("item_id", "item").collect()
        held = _Items([r.item_id for r in rows], [r.item for r in rows], run)
        if not len(held.hash):
            return docs.sparkSession.createDataFrame([], RESULT)
        found = spread(d).mapInArrow(_scan(held, run), RESULT)
    else:
        a = d.mapInArrow(_winnow(run), "id long, h long")
        b = i.mapInArrow(_winnow(run), "id long, h long")
        b = b.withColumnRenamed("id", "item_id")
        seen = d.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).mapInArrow(_winnow(run), "id long, h long").join(b.select("h").distinct(), "h", "left_semi")
        hot = materialize(seen.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("h", F.lit(True).alias("hot")), "lk-hot")
        salt = F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")
        a = a.join(hot, "h", "left").select("id", "h", F.when(F.col("hot"), salt).otherwise(F.lit(0)).alias("salt"))
        every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
        b = b.join(hot, "h", "left").select("item_id", "h", F.explode(every).alias("salt"))
        near = a.join(b, ["h", "salt"]).select(F.col("id").alias("doc_id"), "item_id").distinct()
        found = near.join(d, "doc_id").join(i, "item_id").select("doc_id", "text", "item_id", "item").mapInArrow(_pair_scan(run), RESULT)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("covered", "longest", "tiles", "item_words", "coverage")).alias("m"))
    return best.where(F.col("m.coverage") >= min_coverage).select("doc_id", "item_id", "m.tiles", "m.longest", "m.covered", "m.item_words", "m.coverage")

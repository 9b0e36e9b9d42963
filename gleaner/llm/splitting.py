"""Oversized texts cut into pieces at natural boundaries, by lexical cohesion.

Boundaries are the position after a line feed and the position between one of ``. ! ?`` and
a following space, tab, CR or LF. At each boundary the words of the blocks before and after
are compared (cosine of word counts); a valley of this similarity marks a change of topic,
and its depth is how far the similarity rises on both sides. Within each window of the size
limit the deepest valley is the cut; then the overlap is put before the next piece.

Scale: one pass without a shuffle; a text is a row and only oversized texts are sent to
Python. Memory is in proportion to the longest single text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP = 4096, 256
#: Index values of one file that are numbered in one task.
SPAN = 8192
_BOUNDARY = re.compile(rb"\n|[.!?](?=[ \t\r\n])")
_WORD = re.compile(r"\w+")


def boundaries(data: bytes) -> np.ndarray:
    """Byte positions of the natural boundaries inside ``data``, in order."""
    at = np.fromiter((m.end() for m in _BOUNDARY.finditer(data)), np.int64)
    return at[at < len(data)]


def is_forced(data: bytes, limit: int = LIMIT) -> bool:
    """Whether some stretch of more than ``limit`` bytes has no natural boundary inside."""
    edges = np.concatenate([[0], boundaries(data), [len(data)]])
    return bool((np.diff(edges) > limit).any())


def _character_start(data: bytes, at: int) -> int:
    """The position at or before ``at`` where a UTF-8 character begins."""
    while at > 0 and at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def valley_depths(data: bytes, at: np.ndarray, block: int) -> np.ndarray:
    """Depth of the similarity valley at each boundary; ``block`` segments are compared on each side."""
    edges = np.concatenate([[0], at, [len(data)]])
    ids: dict[str, int] = {}
    words, seg = [], []
    for i in range(len(edges) - 1):
        for w in _WORD.findall(data[edges[i] : edges[i + 1]].decode("utf-8", "replace").lower()):
            words.append(ids.setdefault(w, len(ids)))
            seg.append(i)
    n = len(edges) - 1
    if not words:
        return np.zeros(len(at))
    # similarity at boundary b of the segments [b - block + 1, b] and [b + 1, b + block]; slide both blocks
    starts = np.searchsorted(np.array(seg), np.arange(n + 1)).tolist()
    lists = [words[starts[i] : starts[i + 1]] for i in range(n)]
    left, right = [0] * len(ids), [0] * len(ids)
    for i in range(1, min(block, n - 1) + 1):
        for w in lists[i]:
            right[w] += 1
    for w in lists[0]:
        left[w] += 1
    dot, ll, rr = (float(sum(x * y for x, y in zip(p, q, strict=True))) for p, q in ((left, right), (left, left), (right, right)))
    score = np.zeros(len(at))
    for b in range(len(at)):
        score[b] = dot / math.sqrt(ll * rr) if ll > 0 and rr > 0 else 0.0
        # the next segment b + 1 moves from the right block to the left one
        for w in lists[b + 1]:
            rr += 1 - 2 * right[w]
            dot -= left[w]
            right[w] -= 1
            ll += 1 + 2 * left[w]
            dot += right[w]
            left[w] += 1
        if b + 1 + block < n:
            for w in lists[b + 1 + block]:
                rr += 1 + 2 * right[w]
                dot += left[w]
                right[w] += 1
        if b + 1 - block >= 0:
            for w in lists[b + 1 - block]:
                ll += 1 - 2 * left[w]
                dot -= right[w]
                left[w] -= 1
    depth = np.zeros(len(at))
    for sign in (1, -1):  # climb to the peak on each side: what the boundary before reaches, if the way there does not go down
        s = score[::sign].tolist()
        peak = s[:]
        for b in range(1, len(s)):
            if s[b - 1] >= s[b]:
                peak[b] = peak[b - 1]
        depth += (np.array(peak) - s)[::sign]
    return depth


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP, block: int = 6) -> list[tuple[int, int, int, bool]]:
    """Pieces ``(start, end, fresh, natural)`` in bytes of the UTF-8 text.

    ``fresh`` is where the piece goes on from the one before; ``[start, fresh)`` repeats up to
    ``overlap`` bytes of it. ``natural`` tells whether the piece ends at a natural boundary or
    at the end of the text. Without a boundary in reach the cut falls between two characters.
    The ``[fresh, end)`` ranges join to the whole text, and no piece is longer than ``limit``.
    """
    if not 0 <= overlap < limit - 8:
        raise ValueError("overlap must be smaller than limit")
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return []
    if len(data) <= limit:
        return [(0, len(data), 0, True)]
    at = boundaries(data)
    depth = valley_depths(data, at, block) if len(at) else np.zeros(0)
    out, fresh, start = [], 0, 0
    while True:
        if len(data) - start <= limit:
            out.append((start, len(data), fresh, True))
            return out
        # a third of the window at least is used, if a boundary lies there; else any boundary after what is done
        lo, hi = np.searchsorted(at, [fresh, start + limit], "right")
        late = np.searchsorted(at, max(fresh, start + limit // 3), "right")
        if hi > late:
            lo = late
        elif hi > lo:
            lo = hi - 1
        if hi > lo:
            best = lo + int(np.argmax(depth[lo:hi][::-1]))
            best = hi - 1 - (best - lo)  # of equally deep valleys the last
            end, natural = int(at[best]), True
        else:
            end, natural = _character_start(data, start + limit), False
        out.append((start, end, fresh, natural))
        fresh = end
        start = max(end - overlap, out[-1][0] + 1)
        inside = at[np.searchsorted(at, start, "left") : np.searchsorted(at, end, "left")]
        start = int(inside[0]) if len(inside) else start
        while start < end and data[start] & 0xC0 == 0x80:
            start += 1


PIECES = "id string, piece int, start_byte long, end_byte long, fresh_byte long, natural boolean, forced int, content string"


def _run(limit: int, overlap: int, with_content: bool):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            size = 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                forced = int(is_forced(data, limit))
                for k, (s, e, f, n) in enumerate(split(text, limit, overlap)):
                    rows.append((i, k, s, e, f, n, forced, data[s:e].decode("utf-8", "replace") if with_content else None))
                    size += e - s
                if size > 8_000_000:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return go


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [c.split()[0] for c in PIECES.split(", ")])


def split_oversized(df: DataFrame, id_col: str = "chunk_id", text_col: str = "content", limit: int = LIMIT, overlap: int = OVERLAP, with_content: bool = True) -> DataFrame:
    """Pieces of every text longer than ``limit`` bytes, with byte ranges within the text.

    ``piece`` counts from 0 within an id, ``forced`` is 1 if the text has a stretch of more than
    ``limit`` bytes without a natural boundary. Null ids or texts and texts within the limit
    give no row; of repeated rows of an id one is taken (the smallest text, should they
    differ); an empty table gives an empty result.
    """
    big = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    big = big.where(F.col("id").isNotNull() & (F.octet_length("text") > limit))
    big = big.groupBy("id").agg(F.min("text").alias("text"))
    return big.mapInArrow(_run(limit, overlap, with_content), PIECES)


def reindex(df: DataFrame, pieces: DataFrame, path: str = "file_path", order: str = "chunk_index") -> DataFrame:
    """All chunks with the oversized ones replaced by their pieces and a running index per file.

    Per file the new index counts pieces in the order of the old chunks, by a running sum of
    piece counts; byte ranges of pieces are those within the chunk's content.
    """
    chunks = df.where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.min(path).alias(path), F.min(order).alias(order), F.max(F.octet_length("content")).alias("bytes"))
    counted = pieces.groupBy(F.col("id").alias("chunk_id")).agg(F.count("*").alias("n"))
    chunks = chunks.join(counted, "chunk_id", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    # a running sum in two steps, so that no task holds more than SPAN index values of one file
    chunks = chunks.withColumn("span", F.floor(F.coalesce(F.col(order), F.lit(0)) / SPAN))
    spans = chunks.groupBy(path, "span").agg(F.sum("n").alias("t"))
    earlier = Window.partitionBy(path).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col(path).alias("_p"), F.col("span").alias("_s"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("done"))
    chunks = chunks.join(spans, F.col(path).eqNullSafe(F.col("_p")) & (F.col("span") == F.col("_s"))).drop("_p", "_s")
    before = Window.partitionBy(path, "span").orderBy(order, "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("base", F.col("done") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    cut = pieces.select(F.col("id").alias("chunk_id"), "piece", "start_byte", "end_byte")
    out = chunks.join(cut, "chunk_id", "left")
    return out.select(
        "chunk_id", path, F.coalesce("piece", F.lit(0)).alias("piece"), (F.col("base") + F.coalesce("piece", F.lit(0))).cast("int").alias("chunk_index"),
        F.coalesce("start_byte", F.lit(0).cast("long")).alias("start_byte"), F.coalesce("end_byte", F.col("bytes").cast("long")).alias("end_byte"),
    )

"""Texts placed into containers of fixed token capacity, by vector bin packing.

An item has three sizes: tokens, segments (one) and loss-bearing tokens; a container has a
limit for each. The dot-product heuristic fills one container after another: of the items
that still fit in every dimension it takes the one whose sizes, weighted by how scarce each
dimension is overall, have the largest dot product with the capacity that is left.

An item that alone bears more loss than the limit counts as the limit there: it is not split for it, and
shares a container only with items that bear none.

Scale: sizes are counted where the texts lie; only the sizes are shuffled, into groups of
about ``group`` items by a hash of the id, and each group is packed on its own in order of id, so the
outcome depends on neither cores nor batches. A group
leaves at most a few containers part full, so the unused share does not grow with the data.
Full containers that an item larger than the capacity is split into need no packing.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.runtime import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Limits of a container: tokens, segments and loss-bearing tokens.
CAPACITY, MAX_SEGMENTS, MAX_LOSS = 2048, 16, 2016
#: Splits text into words, numbers, signs and white space before byte pairs are merged (fixed value of the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_TURN = re.compile(r"(?m)^(user|assistant|system):")

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, read once per process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def loss_tokens(text: str, total: int, enc) -> int:
    """Tokens that bear loss: those of the assistant's turns if the text has turns, else all."""
    turns = list(_TURN.finditer(text))
    if not any(t.group(1) == "assistant" for t in turns):
        return total
    ends = [t.start() for t in turns[1:]] + [len(text)]
    return min(total, sum(len(enc.encode_ordinary(text[t.end() : e])) for t, e in zip(turns, ends, strict=True) if t.group(1) == "assistant"))


def token_sizes(df: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """``(id, tokens, loss)`` of every row with an id and a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            n, loss = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, t in enumerate(b.column(1).to_pylist()):
                n[i] = len(enc.encode_ordinary(t))
                loss[i] = loss_tokens(t, int(n[i]), enc)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(loss)], ["id", "tokens", "loss"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(rows.where("id is not null and text is not null")).mapInArrow(run, "id long, tokens long, loss long")


def pack(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of each item; ``sizes`` has a row per item and a column per dimension."""
    n = len(sizes)
    out = np.full(n, -1, np.int64)
    if not n:
        return out
    scaled = sizes / limits
    weight = scaled.sum(0) / max(1.0, scaled.sum(0).max())
    value = scaled * weight
    order = np.argsort(-value.sum(1), kind="stable")
    sizes, scaled, value = sizes[order], scaled[order], value[order]
    # items of the same sizes are interchangeable: pack kinds with counts
    kinds, back = np.unique(sizes, axis=0, return_inverse=True)
    back = back.reshape(-1)
    where = np.argsort(back, kind="stable")
    first = np.searchsorted(back[where], np.arange(len(kinds)))
    used, left = np.zeros(len(kinds), np.int64), np.bincount(back, minlength=len(kinds))
    kvalue = kinds / limits * weight
    box = np.full(n, -1, np.int64)
    container, free, placed = 0, limits.astype(np.float64).copy(), 0
    while placed < n:
        fits = (left > 0) & (kinds <= free).all(1)
        if not fits.any():
            container, free = container + 1, limits.astype(np.float64).copy()
            continue
        score = kvalue @ (free / limits)
        k = int(np.argmax(np.where(fits, score, -1)))
        box[where[first[k] + used[k]]] = container
        used[k] += 1
        left[k] -= 1
        free -= kinds[k]
        placed += 1
    out[order] = box
    return out


PLACED = "doc_id long, piece int, token_start long, token_end long, tokens int, loss_tokens int, container string"


def fill_containers(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    capacity: int = CAPACITY,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int | None = MAX_LOSS,
    group: int = 8192,
) -> DataFrame:
    """Every text in a container: ``(doc_id, piece, token_start, token_end, tokens, loss_tokens, container)``.

    A text of at most ``capacity`` tokens is one piece; a larger one is cut into full containers
    and a rest that is packed with others. No container holds more than
    ``capacity`` tokens or ``max_segments`` pieces, nor more than ``max_loss`` (null: no limit)
    loss-bearing tokens unless a single piece brings them. Loss-bearing tokens of a cut text are shared out in proportion.

    Null ids or texts have no row; an empty text takes a segment and no tokens; of repeated
    rows of an id the longest is taken; an empty table gives an empty result.
    """
    max_loss = capacity if max_loss is None else max_loss
    if capacity < 1 or max_segments < 1 or max_loss < 1:
        raise ValueError("capacity, max_segments and max_loss must be positive")
    groups = max(1, -(-df.where(F.col(id_col).isNotNull()).count() // group))
    sized = token_sizes(df, id_col, text_col, vocabulary).groupBy("id").agg(F.max(F.struct("tokens", "loss")).alias("s"))
    sized = sized.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"), "id", "s.tokens", "s.loss")
    limits = np.array([capacity, max_segments, max_loss])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        current: int | None = None

        def flush() -> pa.RecordBatch:
            ids, tokens, loss = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            whole = np.maximum(-(-tokens // capacity) - 1, 0)  # the last piece is packed as a rest, even if it is full
            row = np.repeat(np.arange(len(ids)), whole + 1)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(whole + 1) - whole - 1, whole + 1)
            start = piece * capacity
            end = np.minimum(start + capacity, tokens[row])
            size = end - start
            total = np.maximum(tokens[row], 1)
            share = loss[row] * end // total - loss[row] * start // total
            rest = piece == whole[row]
            box = np.empty(len(row), object)
            box[~rest] = [f"{ids[r]}.{p}" for r, p in zip(row[~rest], piece[~rest], strict=True)]
            sizes = np.stack([size[rest], np.ones(rest.sum(), np.int64), np.minimum(share[rest], max_loss)], 1)
            box[rest] = [f"{current}-{k}" for k in pack(sizes, limits)]
            cols = [pa.array(ids[row]), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(end), pa.array(size.astype(np.int32)), pa.array(share.astype(np.int32)), pa.array(box, pa.string())]
            return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in PLACED.split(", ")])

        for b in batches:
            g = b.column("g").to_numpy()
            edges = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else []
            for lo, hi in zip(edges, [*edges[1:], len(g)], strict=True):
                if held and g[lo] != current:
                    yield flush()
                current = int(g[lo])
                held.append(tuple(b.column(c).to_numpy()[lo:hi].copy() for c in ("id", "tokens", "loss")))
        if held:
            yield flush()

    return sized.repartitionById(groups, F.col("g")).sortWithinPartitions("g", "id").mapInArrow(run, PLACED)


def utilisation(placed: DataFrame, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS) -> DataFrame:
    """One row: containers, their tokens, the share of the capacity in use, the fullest container in each dimension, and how many containers reach each limit.

    A limit counts as reached within 1 % of it. No rows give zeros and nulls.
    """
    boxes = placed.groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("s"), F.sum("loss_tokens").alias("l"))
    full = lambda c, limit: F.coalesce(F.sum((F.col(c) >= 0.99 * limit).cast("long")), F.lit(0))
    return boxes.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.round(F.sum("t") / (F.count("*") * capacity), 6).alias("used"),
        F.max("t").alias("most_tokens"), F.max("s").alias("most_segments"), F.max("l").alias("most_loss"),
        full("t", capacity).alias("full_of_tokens"), full("s", max_segments).alias("full_of_segments"), full("l", max_loss).alias("full_of_loss"),
    )

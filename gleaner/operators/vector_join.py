"""Exact similarity self-join on vectors: all pairs at or above a cosine, without comparing all pairs.

Unit vectors are assigned to pivots. If two vectors lie within the angle T of each other and
one lies at angle d from its nearest pivot, the other's pivot is at most d + 2T away from the
first; and a pivot whose vectors lie within the angle r holds nothing for a vector that is more
than r + T away from it. A vector visits the pivots that pass both bounds, and of the two pivots of a pair
only the one of lower number is visited. A pivot's vectors form a
block that stays in a task while the visitors stream past it; large blocks are split by hash
and visitors go to every split. The number of pivots grows with the rows,
up to an eighth of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.runtime import materialize


def vector_bytes(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows, np.float32)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def vector_rows(column: pa.Array, dim: int) -> np.ndarray:
    if not len(column):
        return np.empty((0, dim), np.float32)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float32).reshape(len(column), dim)


def unit_classes(df: DataFrame, id_col: str, vec_col: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """``(class, v)`` of the distinct unit vectors as bytes, and ``(id, class)``; ids without a direction are left out."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dim)
            n = np.sqrt((m * m).sum(1))
            ok = np.isfinite(n) & (n > 0)
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(ok)), vector_bytes(m[ok] / n[ok][:, None] + 0.0)], ["id", "v"])

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull()))
    units = materialize(rows.mapInArrow(scale, "id string, v binary").withColumn("h", F.sha2("v", 256)), "vj-units")
    classes = units.groupBy("h").agg(F.min("id").alias("class"), F.first("v").alias("v"))
    members = units.select("id", "h").distinct().join(classes.select("h", "class"), "h").select("id", "class")
    return classes.select("class", "v"), members


def _pivots(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = sample[rng.choice(len(sample), k, replace=False)].astype(np.float64)
    for _ in range(6):
        at = np.argmax(sample @ c.T, 1)
        for j in range(k):
            if (at == j).any():
                s = sample[at == j].sum(0)
                c[j] = s / max(np.linalg.norm(s), 1e-12)
    return c


def similarity_join(df: DataFrame, id_col: str, vec_col: str, threshold: float, dim: int = 64, block: int = 8192, sample: int = 20_000, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b, cosine)`` of distinct directions with cosine ``threshold`` or more, and ``(id, class)``.

    Rows whose vectors point the same way form a class named by its smallest id; pairs are
    between classes, ``a < b``. Null ids and vectors that are null, zero or of another length
    take no part; an empty table gives empty results.
    """
    spark = df.sparkSession
    classes, members = unit_classes(df, id_col, vec_col, dim)
    classes = materialize(classes, "vj-classes")
    n = classes.count()
    if n < 2:
        return spark.createDataFrame([], "a string, b string, cosine double"), members
    got = classes.select("v").where(F.pmod(F.xxhash64("class", F.lit(seed)), F.lit(max(1, n // sample))) == 0).limit(sample).collect() or classes.select("v").limit(1).collect()
    known = np.frombuffer(b"".join(bytes(r.v) for r in got), np.float32).reshape(-1, dim).astype(np.float64)
    pivots = _pivots(known, int(min(max(1, n // 2000), max(1, len(known) // 8))), np.random.default_rng(seed))
    link = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-5

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = vector_rows(b.column("v"), dim)
            s = x @ pivots.T
            home = np.argmax(s, 1)
            away = np.arccos(np.clip(s[np.arange(len(x)), home], -1, 1)) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column("class"), b.column("v"), pa.array(home.astype(np.int32)), pa.array(away)], ["class", "v", "home", "away"])

    placed = materialize(classes.mapInArrow(place, "class string, v binary, home int, away double"), "vj-placed")
    held, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in placed.groupBy("home").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect():  # one row a pivot
        held[r.home], radius[r.home] = r.n, r.away
    splits = np.maximum(1, -(-held // block))
    first = np.concatenate([[0], np.cumsum(splits)])[:-1]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, home = vector_rows(b.column("v"), dim), b.column("home").to_numpy()
            salt = b.column("salt").to_numpy().view(np.uint64)
            own = first[home] + (salt % splits[home].astype(np.uint64)).astype(np.int64)
            angle = np.arccos(np.clip(x @ pivots.T, -1, 1))
            near = (angle <= angle.min(1, keepdims=True) + 2 * link) & (angle <= radius + link) & (held > 0)[None, :]
            i, j = np.nonzero(near & (np.arange(len(pivots))[None, :] <= home[:, None]))
            row = np.repeat(i, splits[j])
            at = np.repeat(first[j], splits[j]) + np.arange(len(row)) - np.repeat(np.cumsum(splits[j]) - splits[j], splits[j])
            rows = np.concatenate([np.arange(b.num_rows), row])
            kind = np.concatenate([np.zeros(b.num_rows, np.int8), np.ones(len(row), np.int8)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own, at]).astype(np.int32)), pa.array(kind), b.column("class").take(pa.array(rows)), pa.array(home[rows]), vector_bytes(x[rows])], ["block", "kind", "class", "home", "v"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, names, vectors, matrix, own = None, [], [], None, -1
        for b in batches:
            blocks, kind = b.column("block").to_numpy(), b.column("kind").to_numpy()
            x, ids, home = vector_rows(b.column("v"), dim), np.array(b.column("class").to_pylist(), object), b.column("home").to_numpy()
            change = np.flatnonzero(np.diff(blocks.astype(np.int64) * 2 + kind)) + 1
            for lo, hi in zip(np.append(0, change), np.append(change, len(blocks)), strict=True):
                if lo == hi:
                    continue
                if blocks[lo] != current:
                    current, names, vectors, matrix, own = blocks[lo], [], [], None, home[lo]
                if kind[lo] == 0:
                    names.append(ids[lo:hi])
                    vectors.append(x[lo:hi].copy())
                    continue
                if matrix is None:
                    matrix, who = np.concatenate(vectors).astype(np.float64), np.concatenate(names)
                for p in range(lo, hi, 256):
                    s = x[p : min(p + 256, hi)].astype(np.float64) @ matrix.T
                    i, j = np.nonzero(s >= threshold - 1e-9)
                    low = ids[p + i] < who[j]
                    ok = low | (home[p + i] != own)  # within a pivot both rows visit
                    if ok.any():
                        i, j, low = i[ok], j[ok], low[ok]
                        a, b_ = np.where(low, ids[p + i], who[j]), np.where(low, who[j], ids[p + i])
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b_, pa.string()), pa.array(s[i, j])], ["a", "b", "cosine"])

    routed = placed.withColumn("salt", F.xxhash64("class")).mapInArrow(route, "block int, kind byte, class string, home int, v binary")
    routed = routed.repartitionById(int(splits.sum()), F.col("block")).sortWithinPartitions("block", "kind")
    return routed.mapInArrow(meet, "a string, b string, cosine double"), members

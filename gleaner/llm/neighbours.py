"""Most similar vectors for every vector, through an inverted multi-index.

Vectors are scaled to unit length and cut in two halves; each half has its own codebook,
so ``K`` centroids a half give ``K * K`` cells. A query walks the centroid pairs in order
of summed distance with a heap until the visited cells hold ``candidates`` entries of other
groups, and the entries are reranked by exact cosine. Cells that lie close together are packed into blocks
of about ``block`` vectors; a block is the unit that travels to a task, and every entry of
a visited block is reranked, so the effective candidate list is larger than asked for. With
``candidates`` of at least the number of rows every block is visited and the answer is exact.

Scale: the only things on the driver are a bounded training sample, the two codebooks, one
population count per cell (``K`` is capped) and bounded counts of the largest groups. The number of blocks
grows with the rows, without a limit. Nothing but the small table of memberships is stored: vectors
are read where they are used and move twice, once to collapse equal ones and once to their blocks. A
block of more than twice the target size is split by hash and visited in all its splits; a block that
many queries visit is given to several tasks, each with a part of the queries. How many is estimated
on the sample and only shapes the layout. Work is (rows) x (visited blocks) x (block size).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.words import mix
from gleaner.operators.vector_join import vector_bytes, vector_rows
from gleaner.runtime import materialize

#: Groups that one step of packing makes of the cells.
FANOUT = 32
#: Centroids of a half at most.
MAX_WIDTH = 1024
MAX_SIZES = 100_000
MAX_COUNTS = 2_000_000
TIE = 1e-6


def unit_vectors(df: DataFrame, id_col: str, group_col: str, vec_col: str, dim: int) -> DataFrame:
    """``(id, grp, vid, v)``: unit-length vectors as bytes, with a hash of vector and group.

    Rows with a null id, a null or all-zero vector, a vector of another length or one with a
    null or non-finite entry have no direction and are left out; a null group counts as a group
    of its own. Ids that come several times count once.
    """

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            m = flat.reshape(len(lists), dim)
            norm = np.sqrt((m * m).sum(1))
            keep = np.isfinite(norm) & (norm > 0)
            m = (m[keep] / norm[keep][:, None]).astype(np.float32)
            m += 0.0  # -0.0 and 0.0 are the same direction
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask), vector_bytes(m)], ["id", "fh", "v"])

    rows = df.select(
        F.col(id_col).cast("string").alias("id"), F.xxhash64(F.col(group_col).cast("string")).alias("fh"), F.col(vec_col).cast("array<float>").alias("v")
    ).where(F.col("id").isNotNull() & (F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull()))
    return rows.mapInArrow(scale, "id string, fh long, v binary").withColumn("vid", F.xxhash64("v"))


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, weight: np.ndarray | None = None) -> np.ndarray:
    w = np.ones(len(x), np.float32) if weight is None else weight.astype(np.float32)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False, p=w / w.sum()))].copy() if (w > 0).sum() >= k else x.copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + 8192] @ c.T - 0.5 * (c * c).sum(1), 1) for i in range(0, len(x), 8192)])
        total = np.bincount(near, weights=w, minlength=len(c))
        some = total > 0
        for d in range(x.shape[1]):
            c[some, d] = np.bincount(near, weights=w * x[:, d], minlength=len(c))[some] / total[some]
    return c


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1), 0)


class MultiIndex:
    """Two codebooks, the population of each centroid pair, and the block of each pair.

    A block has ``splits`` of its entries times ``parts`` of its queries as tasks, numbered from ``first``.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left, right
        self.half = left.shape[1]
        self.population: np.ndarray = np.zeros(0, np.int64)
        self.block: np.ndarray = np.zeros(0, np.int32)
        self.first: np.ndarray = np.zeros(0, np.int64)
        self.splits: np.ndarray = np.zeros(0, np.int64)
        self.parts: np.ndarray = np.zeros(0, np.int64)

    @classmethod
    def fit(cls, sample: np.ndarray, k: int, seed: int) -> MultiIndex:
        rng, half = np.random.default_rng(seed), sample.shape[1] // 2
        return cls(_kmeans(sample[:, :half], k, 10, rng), _kmeans(sample[:, half:], k, 10, rng))

    def cells(self, x: np.ndarray) -> np.ndarray:
        a = np.argmin(_squared(x[:, : self.half], self.left), 1)
        b = np.argmin(_squared(x[:, self.half :], self.right), 1)
        return (a * len(self.right) + b).astype(np.int64)

    def pack(self, cell: np.ndarray, count: np.ndarray, block: int, seed: int) -> None:
        """Group neighbouring cells into blocks of about ``block`` entries, step by step; a block beyond twice the target is split."""
        width = len(self.right)
        self.population = np.zeros(len(self.left) * width, np.int64)
        self.population[cell] = count
        centre = np.hstack([self.left[cell // width], self.right[cell % width]])
        own, blocks, rng = np.zeros(len(cell), np.int32), 0, np.random.default_rng(seed)
        open_ = [np.arange(len(cell))]
        while open_:
            at = open_.pop()
            wanted = min(len(at), math.ceil(count[at].sum() / block))
            near = np.zeros(len(at), np.int64)
            if wanted > 1:
                near = np.argmin(_squared(centre[at], _kmeans(centre[at], min(FANOUT, wanted), 12, rng, count[at])), 1)
            if near.max() == 0:  # one group, or cells that no centroid tells apart
                own[at] = blocks
                blocks += 1
            elif wanted <= FANOUT:
                there = np.unique(near, return_inverse=True)
                own[at] = blocks + there[1]
                blocks += len(there[0])
            else:
                open_ += [at[near == g] for g in np.unique(near)]
        self.block = np.full(len(self.population), -1, np.int32)
        self.block[cell] = own
        held = np.bincount(own, weights=count, minlength=blocks)
        self.splits = np.where(held > 2 * block, np.ceil(held / block), 1).astype(np.int64)
        self.share(np.ones(blocks, np.int64))

    def share(self, parts: np.ndarray) -> None:
        """Give the queries of each block to ``parts`` tasks."""
        self.parts = np.maximum(parts, 1).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.splits * self.parts)])[:-1]

    @property
    def tasks(self) -> int:
        return int((self.splits * self.parts).sum())

    def visited(self, x: np.ndarray, candidates: int | np.ndarray, population: np.ndarray | None = None) -> list[set[int]]:
        """For each row, the blocks of the nearest centroid pairs that hold ``candidates`` entries, or as many of ``population``."""
        d1, d2 = _squared(x[:, : self.half], self.left), _squared(x[:, self.half :], self.right)
        o1, o2 = np.argsort(d1, 1), np.argsort(d2, 1)
        d1, d2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
        width, block = len(self.right), self.block
        population = self.population if population is None else population
        limits = np.minimum(np.broadcast_to(candidates, len(x)), int(population.sum())).tolist()
        push, pop, out = heapq.heappush, heapq.heappop, []
        last1, last2 = len(self.left) - 1, width - 1
        for r in range(len(x)):
            a, b, p, q, wanted = d1[r].tolist(), d2[r].tolist(), (o1[r] * width).tolist(), o2[r].tolist(), limits[r]
            heap, held, found = [(a[0] + b[0], 0, 0)], 0, set()
            while held < wanted:
                _, i, j = pop(heap)
                cell = p[i] + q[j]
                n = population.item(cell)
                if n:
                    held += n
                    found.add(block.item(cell))
                if j < last2:
                    push(heap, (a[i] + b[j + 1], i, j + 1))
                if j == 0 and i < last1:
                    push(heap, (a[i + 1] + b[0], i + 1, 0))
            out.append(found)
        return out


class Own:
    """How many entries are of the asking group alone, which never answer it.

    ``counts`` has the entries of the largest groups by cell and ``sizes`` the number of entries
    of further large groups; the others have at most ``rest``.
    """

    def __init__(self, sizes: dict[int, int], rest: int, counts: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.sizes, self.rest, self.counts = sizes, rest, counts

    @classmethod
    def of(cls, placed: DataFrame, candidates: int, cells: int) -> Own:
        rest = candidates // 64
        groups = placed.where(F.col("sole") != 0).groupBy("sole").count().where(F.col("count") > rest)
        large = [(r["sole"], r["count"]) for r in groups.orderBy(F.desc("count"), "sole").limit(MAX_SIZES).collect()]
        if len(large) == MAX_SIZES:
            rest = large[-1][1]
        hot, held = [], 0
        for g, n in large:
            held += min(n, cells)
            if n < candidates // 8 or held > MAX_COUNTS or len(hot) == 1024:
                break
            hot.append(g)
        counts = {}
        if hot:
            t = placed.where(F.col("sole").isin(hot)).groupBy("sole", "cell").count().toPandas()
            for g, part in t.groupby("sole"):
                counts[int(g)] = part["cell"].to_numpy(np.int32), part["count"].to_numpy(np.int32)
        return cls(dict(large), rest, counts)

    def visited(self, index: MultiIndex, x: np.ndarray, groups: np.ndarray, candidates: int) -> list[set[int]]:
        """For each row, blocks that hold ``candidates`` entries of groups other than its own, or all there are."""
        out: list[set[int]] = [set()] * len(x)
        hot = np.isin(groups, np.fromiter(self.counts, np.int64, len(self.counts)))
        at = np.flatnonzero(~hot)
        more = np.array([self.sizes.get(g, self.rest) for g in groups[at].tolist()], np.int64)
        for i, s in zip(at.tolist(), index.visited(x[at], candidates + more), strict=True):
            out[i] = s
        for g in np.unique(groups[hot]):
            population = index.population.copy()
            cell, n = self.counts[int(g)]
            population[cell] -= n
            at = np.flatnonzero(groups == g)
            for i, s in zip(at.tolist(), index.visited(x[at], candidates, population), strict=True):
                out[i] = s
        return out


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...``, ``count[i]`` of them, one after the other."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def _route(index: MultiIndex, own_entries: Own, candidates: int, dim: int):
    """Each vector as an entry of its block, once for each part of the block's queries, and as a query in every block it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            vid, sole, x = b.column("vid").to_numpy(), b.column("sole").to_numpy(), vector_rows(b.column("v"), dim)
            own = index.block[index.cells(x)]
            split = (vid.view(np.uint64) % index.splits[own].astype(np.uint64)).astype(np.int64)
            copies = index.parts[own]
            rows, tasks, files = [np.repeat(np.arange(len(vid)), copies)], [_ranges(index.first[own] + split * copies, copies)], [np.repeat(sole, copies)]
            entries = len(rows[0])
            asks = b.column("ask")
            who = np.repeat(np.arange(len(vid)), np.diff(asks.offsets.to_numpy()))
            if len(who):
                group = asks.flatten().to_numpy()
                seen = own_entries.visited(index, x[who], group, candidates)
                q = np.repeat(np.arange(len(who)), [len(s) for s in seen])
                at = np.fromiter((k for s in seen for k in sorted(s)), np.int64, len(q))
                part = (mix(vid[who[q]].view(np.uint64) ^ group[q].view(np.uint64)) % index.parts[at].astype(np.uint64)).astype(np.int64)
                n = index.splits[at]
                q, at, part = np.repeat(q, n), np.repeat(at, n), np.repeat(part, n)
                rows.append(who[q])
                tasks.append(index.first[at] + _ranges(np.zeros(len(n), np.int64), n) * index.parts[at] + part)
                files.append(group[q])
            row = np.concatenate(rows)
            kind = np.ones(len(row), np.int8)
            kind[:entries] = 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tasks).astype(np.int32)), pa.array(kind), pa.array(vid[row]), pa.array(np.concatenate(files)), vector_bytes(x[row])],
                ["task", "kind", "vid", "fh", "v"],
            )

    return run


def _best(q: np.ndarray, qf: np.ndarray, items: np.ndarray, sole: np.ndarray, k: int, floor: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and cosine of the ``k`` best entries (with ties) of other groups; ``sole`` ascending, ``qf`` ascending."""
    s = q @ items.T
    files, first = np.unique(qf, return_index=True)
    ends = np.append(first[1:], len(qf))
    lo, hi = np.searchsorted(sole, files, "left"), np.searchsorted(sole, files, "right")
    for g in np.flatnonzero(hi > lo):
        s[first[g] : ends[g], lo[g] : hi[g]] = -2
    if floor is not None:
        r, c = np.nonzero(s >= np.float32(floor - TIE))
    else:
        n = s.shape[1]
        if n > 256:
            w = n // 64
            tops = s[:, : w * 64].reshape(len(s), 64, w).max(1)
            if n % 64:
                tops = np.hstack([tops, s[:, w * 64 :]])
        else:
            tops = s
        least = np.partition(tops, -k, axis=1)[:, -k] if tops.shape[1] > k else np.full(len(s), -1.5, np.float32)
        r, c = np.nonzero(s >= np.maximum(least - TIE, -1.5)[:, None])
    v = s[r, c]
    if len(r):  # at most k a row, and what equals the k-th
        order = np.lexsort((-v, r))
        r, c, v = r[order], c[order], v[order]
        start = np.searchsorted(r, r)
        rank = np.arange(len(r)) - start
        kth = np.minimum(start + k - 1, len(r) - 1)
        keep = (rank < k) | ((r[kth] == r) & (v >= v[kth] - TIE))
        r, c, v = r[keep], c[keep], v[keep]
    return r, c, v


def _search(k: int, floor: float | None, dim: int):
    """Batches sorted by task with entries first: hold one task's entries, stream its queries past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, items = None, [], None
        for b in batches:
            block, kind = b.column("task").to_numpy(), b.column("kind").to_numpy()
            vid, fh, x = b.column("vid").to_numpy(), b.column("fh").to_numpy(), vector_rows(b.column("v"), dim)
            change = np.flatnonzero(np.diff(block.astype(np.int64) * 2 + kind)) + 1
            for lo, hi in zip(np.append(0, change), np.append(change, len(block)), strict=True):
                if hi == lo:
                    continue
                if block[lo] != current:
                    current, parts, items = block[lo], [], None
                if kind[lo] == 0:
                    parts.append((vid[lo:hi].copy(), fh[lo:hi].copy(), x[lo:hi].copy()))
                    continue
                if items is None:
                    if not parts:
                        continue
                    iv, sole, m = (np.concatenate(p) for p in zip(*parts, strict=True))
                    order = np.argsort(sole, kind="stable")
                    items = iv[order], sole[order], m[order]
                step = max(64, min(1024, 4_000_000 // len(items[0])))
                order = lo + np.argsort(fh[lo:hi], kind="stable")
                for at in range(0, len(order), step):
                    part = order[at : at + step]
                    r, c, v = _best(x[part], fh[part], items[2], items[1], k, floor)
                    if len(r):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(vid[part][r]), pa.array(fh[part][r]), pa.array(items[0][c]), pa.array(v.astype(np.float32))], ["qvid", "qfh", "cvid", "cosine"]
                        )

    return run


def similar_vectors(
    df: DataFrame,
    id_col: str,
    group_col: str,
    vec_col: str,
    k: int = 5,
    min_cosine: float | None = None,
    dim: int = 64,
    candidates: int = 4000,
    block: int = 16_384,
    sample: int = 20_000,
    seed: int = 11,
) -> DataFrame:
    """The ``k`` most similar rows of other groups for every row: ``(id, neighbour, cosine, rank)``.

    Equally similar neighbours are ranked by the smaller id. ``min_cosine`` leaves out less
    similar neighbours and so is the same as filtering the result. ``sample`` bounds the rows
    the codebooks are fitted on; every row is indexed and every row is a query.

    See :func:`unit_vectors` for rows without a direction. Rows of one group never answer each
    other; a row with fewer than ``k`` rows in other groups gets what there is; repeated rows
    count once; an empty table gives an empty result.
    """
    spark = df.sparkSession
    out = "id string, neighbour string, cosine double, rank int"
    rows = unit_vectors(df, id_col, group_col, vec_col, dim)
    n = df.where(F.size(vec_col) == dim).count()

    def fitting(share: int) -> tuple[np.ndarray, np.ndarray]:
        """Different vectors of a share of the rows, with the group of one row that has them."""
        drawn = unit_vectors(df.where(F.pmod(F.xxhash64(F.col(vec_col).cast("array<float>"), F.lit(seed)), F.lit(share)) == 0), id_col, group_col, vec_col, dim)
        drawn = drawn.groupBy("vid").agg(F.min("fh").alias("fh"), F.first("v").alias("v")).orderBy(F.xxhash64("vid", F.lit(seed)), "vid").limit(sample).collect()
        return np.frombuffer(b"".join(bytes(r.v) for r in drawn), np.float32).reshape(-1, dim), np.array([r.fh for r in drawn], np.int64)

    fitted, groups = fitting(max(1, n // sample))
    if len(fitted) < 64 and n > sample:  # few different vectors, or an unlucky draw
        fitted, groups = fitting(1)
    if not len(fitted):
        return spark.createDataFrame([], out)
    width = int(np.clip(2 ** round(math.log2(max(2.0, math.sqrt(n / 16)))), 4, MAX_WIDTH))
    index = MultiIndex.fit(fitted, min(width, len(fitted)), seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = index.cells(vector_rows(b.column("v"), dim)) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vid"), b.column("fh"), b.column("id"), pa.array(cell.astype(np.int32))], ["vid", "fh", "id", "cell"])

    members = materialize(rows.mapInArrow(place, "vid long, fh long, id string, cell int").distinct(), "nn-members")
    per_file = members.groupBy("vid", "fh").agg(F.count("*").alias("mf"), F.first("cell").alias("cell"))
    total = per_file.groupBy("vid").agg(F.sum("mf").alias("m"), F.count("*").alias("files"), F.min("fh").alias("one"), F.first("cell").alias("cell"))
    total = total.select("vid", "m", "files", "cell", F.when(F.col("files") == 1, F.col("one")).otherwise(F.lit(0).cast("long")).alias("sole"))
    # a class asks for a file only if it cannot itself answer with k members of other files: at most 2k - 1 files a class
    ask = per_file.join(total.select("vid", "m"), "vid").where(F.col("m") - F.col("mf") < k).groupBy("vid").agg(F.collect_list("fh").alias("ask"))
    classes = total.select("vid", "sole").join(ask, "vid", "left").select("vid", "sole", F.coalesce("ask", F.array().cast("array<long>")).alias("ask"))
    counts = total.groupBy("cell").count().toPandas()
    own = Own.of(total, candidates, len(index.left) * len(index.right))
    # of several ways to pack the cells the one in which the sample visits the fewest blocks, and as many tasks a block as its visitors need
    tried, best = fitted[:2048], None
    index.pack(counts["cell"].to_numpy(), counts["count"].to_numpy(), block, seed)
    index.block = np.arange(len(index.population), dtype=np.int32)  # the cells that the sample visits do not depend on the packing
    seen = [np.fromiter(s, np.int64, len(s)) for s in own.visited(index, tried, groups[:2048], candidates)]
    for attempt in range(8):
        index.pack(counts["cell"].to_numpy(), counts["count"].to_numpy(), block, seed + attempt)
        visits = np.bincount(np.concatenate([np.unique(index.block[s]) for s in seen]), minlength=len(index.splits))
        cost = float((visits * index.splits).sum())
        if best is None or cost < best[0]:
            best = cost, attempt, visits
    index.pack(counts["cell"].to_numpy(), counts["count"].to_numpy(), block, seed + best[1])
    cores = spark.sparkContext.defaultParallelism  # a small collection has few blocks: then share their queries out over the cores
    index.share(np.maximum(np.ceil(best[2] / len(tried) * counts["count"].sum() / (4 * block)), -(-cores // int(index.splits.sum()))))
    units = rows.groupBy("vid").agg(F.first("v").alias("v")).join(classes, "vid")
    routed = units.select("vid", "sole", "ask", "v").mapInArrow(_route(index, own, candidates, dim), "task int, kind byte, vid long, fh long, v binary")
    routed = routed.repartitionById(index.tasks, F.col("task")).sortWithinPartitions("task", "kind")
    hits = routed.mapInArrow(_search(k, min_cosine, dim), "qvid long, qfh long, cvid long, cosine float").where("qvid != cvid")
    # classes spread over several files answer themselves, searched for or not
    itself = per_file.join(total.where(F.col("files") > 1).select("vid"), "vid").select(
        F.col("vid").alias("qvid"), F.col("fh").alias("qfh"), F.col("vid").alias("cvid"), F.lit(1.0).cast("float").alias("cosine")
    )
    best = hits.unionByName(itself).withColumn("cosine", F.round(F.col("cosine").cast("double"), 6))
    near = Window.partitionBy("qvid", "qfh").orderBy(F.desc("cosine"))
    best = best.withColumn("place", F.rank().over(near)).where(F.col("place") <= k).drop("place")  # and what equals the k-th
    if min_cosine is not None:
        best = best.where(F.col("cosine") >= min_cosine)
    few = members.withColumn("r", F.row_number().over(Window.partitionBy("vid", "fh").orderBy("id"))).where(F.col("r") <= k)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("vid").orderBy("id"))).where(F.col("r") <= 2 * k)
    answers = best.join(few.select(F.col("vid").alias("cvid"), "fh", F.col("id").alias("neighbour")), "cvid").where(F.col("fh") != F.col("qfh"))
    order = Window.partitionBy("qvid", "qfh").orderBy(F.desc("cosine"), "neighbour")
    answers = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    asking = members.select(F.col("vid").alias("qvid"), F.col("fh").alias("qfh"), "id")
    return answers.join(asking, ["qvid", "qfh"]).select("id", "neighbour", "cosine", F.col("rank").cast("int").alias("rank"))

"""Similarity clusters: distributed k-means with parallel oversampled seeding, then links.

Seeding follows k-means|| (Bahmani et al. 2012): in each round ``oversample`` rows are drawn
with probability in proportion to their squared distance from the seeds so far (an
exponential race decides, so a round is one pass and a bounded top-n), then the few seeds
are weighted by the rows nearest to them and reduced to ``k``. Lloyd rounds follow as passes
that send one partial sum per centroid.

Where clusters are defined by links (cosine of at least ``min_cosine``, directly or through
others) the centroids serve as the index: the members nearest each centroid are its core,
rows are linked to cores, rows that link two cores join them, and the rows that no core
explains, or that come near a second one, are compared with all rows, tile by tile. Then
the linked rows outside the largest cluster are compared with those of other clusters, unless
the angles to the cores exclude any link. So no link is lost: the result is that of comparing all
pairs, and ``k``, ``core`` and ``border`` only decide how much is left for these two steps.

Scale: on the driver are only centroids, cores (``k * core`` rows, ``k`` growing with the square root of the
rows up to ``MAX_K``) and pairs of core groups. The comparisons are tiles that go to tasks, each of which
returns a spanning forest of the links it finds. Sums are pre-aggregated, so a hot file costs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.words import ALNUM, Words, mix, pieces
from gleaner.operators.graph import connected_components
from gleaner.operators.vector_join import vector_bytes, vector_rows
from gleaner.runtime import materialize


#: Centroids that serve as the index, at least and at most.
MIN_K, MAX_K = 64, 1024


def _doubles(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * np.int32(m.shape[1])), pa.array(np.ascontiguousarray(m, np.float64).reshape(-1)))


def _sum_vectors(df: DataFrame, key: str, dim: int) -> DataFrame:
    """``(key, n, s)`` with ``n`` and the vector ``s`` added up per key, combined before the shuffle."""
    parts = df.groupBy(key).agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dim)))
    return parts.select(key, "n", F.array(*(f"s{i}" for i in range(dim))).alias("s"))


def group_vectors(df: DataFrame, id_col: str, group_col: str, vec_col: str, dim: int = 64) -> DataFrame:
    """``(id, v)`` per group: the mean of its rows' unit vectors, itself scaled to unit length, as bytes.

    Null ids or groups and vectors that are null, of another length, all zero or not finite
    take no part, nor does a group whose vectors cancel out; repeated rows of an id count once.
    """
    rows = df.select(F.col(id_col).cast("string").alias("i"), F.col(group_col).cast("string").alias("g"), F.col(vec_col).cast("array<float>").alias("v"))
    rows = rows.where(F.col("i").isNotNull() & F.col("g").isNotNull() & (F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull()))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = b.column("v").flatten().to_numpy().astype(np.float64).reshape(b.num_rows, dim)
            norm = np.sqrt((m * m).sum(1))
            ok = np.isfinite(norm) & (norm > 0)
            code = b.column("g").dictionary_encode()
            own = code.indices.to_numpy()[ok]
            m = m[ok] / norm[ok][:, None]
            if not len(own):
                continue
            order = np.argsort(own, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(own[order]) != 0))
            sums = np.add.reduceat(m[order], first, axis=0)
            n = np.diff(np.append(first, len(own)))
            yield pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(own[order][first])), pa.array(n.astype(np.int64)), _doubles(sums)], ["g", "n", "s"])

    parts = rows.dropDuplicates(["i"]).select("g", "v").mapInArrow(partial, "g string, n long, s array<double>")

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column("s").flatten().to_numpy().reshape(b.num_rows, dim)
            norm = np.sqrt((m * m).sum(1))
            ok = norm > 1e-9
            yield pa.RecordBatch.from_arrays([b.column("g").filter(pa.array(ok)), vector_bytes(m[ok] / norm[ok][:, None])], ["id", "v"])

    return _sum_vectors(parts, "g", dim).mapInArrow(scale, "id string, v binary")


def text_vectors(df: DataFrame, id_col: str, text_col: str, dim: int = 64, buckets: int = 1 << 18) -> DataFrame:
    """``(id, vector array<float>)`` of texts: hashed words, weighted by inverse document frequency and signed.

    Document frequencies are counted over all rows in ``buckets`` hash buckets, so what goes to
    the tasks has a fixed size. Null or wordless texts give a zero vector.
    """

    def bag(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = Words(texts, ALNUM)
        both, n = np.unique(np.stack([w.doc, (w.hash % np.uint64(buckets)).astype(np.int64)], 1), axis=0, return_counts=True)
        return both[:, 0], both[:, 1], n

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in pieces(texts):
                total += np.bincount(bag(texts[lo:hi])[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["b", "n"])

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("t"))
    counted = rows.mapInArrow(frequency, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    df_of = np.ones(buckets)
    df_of[counted["b"].to_numpy(np.int64)] += counted["n"].to_numpy(np.int64)
    idf = (np.log((1 + rows.count()) / df_of) + 1).astype(np.float32)

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            out = np.zeros((b.num_rows, dim), np.float32)
            for lo, hi in pieces(texts):
                doc, word, n = bag(texts[lo:hi])
                h = mix(word.astype(np.uint64))
                sign = np.where(h >> np.uint64(63), 1, -1)
                np.add.at(out, (doc + lo, (h % np.uint64(dim)).astype(np.int64)), (1 + np.log(n)) * idf[word] * sign)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * np.int32(dim)), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], ["id", "vector"])

    return rows.mapInArrow(embed, "id string, vector array<float>")


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre and squared distance to it."""
    s = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    at = np.argmin(s, 1)
    return at, np.maximum(s[np.arange(len(x)), at], 0)


def kmeans(vectors: DataFrame, k: int, dim: int = 64, rounds: int = 5, lloyd: int = 6, seed: int = 5) -> np.ndarray:
    """Centroids of ``(id, v)``; ``v`` is ``dim`` float32 as bytes. At most ``k``, fewer for fewer rows."""
    rng = np.random.default_rng(seed)
    first = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1).collect()
    if not first:
        return np.empty((0, dim), np.float32)
    seeds = np.frombuffer(bytes(first[0].v), np.float32)[None, :]
    for r in range(rounds):
        now = seeds

        def race(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d = _nearest(vector_rows(b.column("v"), dim), now)[1]
                ok = d > 1e-9
                u = (b.column("u").to_numpy().view(np.uint64)[ok] >> np.uint64(11)).astype(np.float64) / 2**53
                key = -np.log(np.maximum(u, 1e-300)) / d[ok]
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column("v").filter(pa.array(ok))], ["key", "v"])

        drawn = vectors.select(F.xxhash64("id", F.lit(seed + r + 1)).alias("u"), "v").mapInArrow(race, "key double, v binary").orderBy("key").limit(2 * k).collect()
        if not drawn:
            break
        seeds = np.vstack([seeds, *(np.frombuffer(bytes(x.v), np.float32)[None, :] for x in drawn)])

    def tally(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, n = np.zeros((len(centres), dim)), np.zeros(len(centres), np.int64)
            for b in batches:
                x = vector_rows(b.column("v"), dim)
                if len(x):
                    at = _nearest(x, centres)[0]
                    n += np.bincount(at, minlength=len(centres))
                    order = np.argsort(at, kind="stable")
                    start = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
                    sums[at[order][start]] += np.add.reduceat(x[order].astype(np.float64), start, axis=0)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), _doubles(sums[some])], ["c", "n", "s"])

        got = _sum_vectors(vectors.select("v").mapInArrow(partial, "c long, n long, s array<double>"), "c", dim).collect()
        n, s = np.zeros(len(centres)), np.zeros((len(centres), dim))
        for row in got:
            n[row.c], s[row.c] = row.n, row.s
        return n, s

    weight = tally(seeds)[0]
    seeds, weight = seeds[weight > 0], weight[weight > 0]
    if len(seeds) > k:  # weighted k-means++ and Lloyd on the few seeds
        pick = [int(np.argmax(weight))]
        d = ((seeds - seeds[pick[0]]) ** 2).sum(1)
        while len(pick) < k and (d * weight).sum() > 0:
            pick.append(int(rng.choice(len(seeds), p=d * weight / (d * weight).sum())))
            d = np.minimum(d, ((seeds - seeds[pick[-1]]) ** 2).sum(1))
        c = seeds[pick].astype(np.float64)
        for _ in range(10):
            at = _nearest(seeds, c)[0]
            n = np.bincount(at, weights=weight, minlength=len(c))
            for j in range(dim):
                c[n > 0, j] = np.bincount(at, weights=weight * seeds[:, j], minlength=len(c))[n > 0] / n[n > 0]
        centres = c.astype(np.float32)
    else:
        centres = seeds
    for _ in range(lloyd):
        n, s = tally(centres)
        moved = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centres).astype(np.float32)
        done = np.abs(moved - centres).max() < 1e-4
        centres = moved
        if done:
            break
    return centres


def assign(vectors: DataFrame, centres: np.ndarray, dim: int) -> DataFrame:
    """``(id, v, cell, near)``: the nearest centroid of each row and the cosine with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = vector_rows(b.column("v"), dim)
            at = _nearest(x, centres)[0] if len(x) else np.empty(0, np.int64)
            c = centres[at]
            near = (x * c).sum(1) / np.maximum(np.sqrt((x * x).sum(1) * (c * c).sum(1)), 1e-12)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(at.astype(np.int32)), pa.array(near.astype(np.float64))], ["id", "v", "cell", "near"])

    return vectors.select("id", "v").mapInArrow(run, "id string, v binary, cell int, near double")


def typical(assigned: DataFrame, cell: str, n: int) -> DataFrame:
    """The ``n`` members nearest the centre of each cell, ties by the smaller id."""
    order = Window.partitionBy(cell).orderBy(F.desc("near"), "id")
    return assigned.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def text_topics(df: DataFrame, id_col: str, text_col: str, k: int | None = None, dim: int = 64, members: int = 5, seed: int = 5) -> DataFrame:
    """``(topic, size, cohesion, typical)``: k-means on hashed weighted features of texts.

    Per topic its number of rows, their mean cosine with the centroid and the ids of the ``members``
    nearest to it, nearest first, ties by the smaller id. Repeated ids count once; null ids and
    texts without words have no direction and belong to no topic; an empty table gives no rows.
    """
    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("t"))
    found = text_vectors(rows.groupBy("id").agg(F.min("t").alias("t")), "id", "t", dim)

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column("vector").flatten().to_numpy().reshape(b.num_rows, dim)
            norm = np.sqrt((m * m).sum(1))
            ok = norm > 0
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(ok)), vector_bytes(m[ok] / norm[ok][:, None])], ["id", "v"])

    vectors = materialize(found.mapInArrow(scale, "id string, v binary"), "ct-vectors")
    n = vectors.count()
    centres = kmeans(vectors, k or int(np.clip(np.sqrt(n) / 4, MIN_K, MAX_K)), dim, seed=seed)
    if not len(centres):
        return df.sparkSession.createDataFrame([], "topic int, size long, cohesion double, typical array<string>")
    placed = materialize(assign(vectors, centres, dim).select("id", "cell", F.round("near", 6).alias("near")), "ct-assigned")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("size"), F.round(F.avg("near"), 6).alias("cohesion"))
    top = typical(placed, "cell", members).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("t"))
    return sizes.join(top, "cell").select(F.col("cell").alias("topic"), "size", "cohesion", F.col("t.id").alias("typical"))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable node of each of ``n`` nodes under the edges ``a - b``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _tile_links(asking: DataFrame, rows: DataFrame, low: np.float32, block: int, dim: int) -> DataFrame:
    """``(a, b)``: spanning forests of the links between two tables ``(node, salt, v)``; nodes that are equal need no link.

    Each task holds ``block`` asking rows and streams its share of the others past them. Both
    tables are copied once per part of the other one, so what moves grows with the product of
    the tables over the size of a tile.
    """
    asks, given = asking.count(), rows.count()
    if not asks or not given:
        return asking.sparkSession.createDataFrame([], "a string, b string")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    across = -(-asks // block)
    down = min(max(-(-given // (4 * block)), -(-cores // across)), -(-given // 1024))
    salted = lambda n: F.pmod("salt", F.lit(n)).cast("int")
    left = asking.select("node", "v", F.lit(0).cast("byte").alias("kind"), salted(across).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("j"))
    right = rows.select("node", "v", F.lit(1).cast("byte").alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("i"), salted(down).alias("j"))
    tiles = left.unionByName(right).select((F.col("i") * down + F.col("j")).alias("tile"), "kind", "node", "v")

    def forest(names: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        root = _roots(len(names), i, j)
        at = np.flatnonzero(root != np.arange(len(root)))
        return at, root[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one tile, asking ones first."""
        current, names, vectors, known, matrix, codes, ends = None, [], [], {}, None, None, []

        def settle() -> pa.RecordBatch | None:
            if not ends:
                return None
            i, j = forest(np.arange(len(known)), *(np.concatenate(x) for x in zip(*ends, strict=True)))
            ends.clear()
            label = np.array(list(known), object)
            return pa.RecordBatch.from_arrays([pa.array(label[i], pa.string()), pa.array(label[j], pa.string())], ["a", "b"])

        for b in batches:
            tile, kind, node, x = b.column("tile").to_numpy(), b.column("kind").to_numpy(), b.column("node").to_pylist(), vector_rows(b.column("v"), dim)
            change = np.flatnonzero(np.diff(tile.astype(np.int64) * 2 + kind)) + 1
            for lo, hi in zip(np.append(0, change), np.append(change, len(tile)), strict=True):
                if lo == hi:
                    continue
                if tile[lo] != current:
                    if (done := settle()) is not None:
                        yield done
                    current, names, vectors, known, matrix = tile[lo], [], [], {}, None
                if kind[lo] == 0:
                    names += node[lo:hi]
                    vectors.append(x[lo:hi].copy())
                    continue
                if not names:
                    continue
                if matrix is None:
                    matrix = np.concatenate(vectors)
                    codes = np.array([known.setdefault(n, len(known)) for n in names])
                own = np.array([known.setdefault(n, len(known)) for n in node[lo:hi]])
                step = max(16, 8_000_000 // len(matrix))
                for at in range(lo, hi, step):
                    i, j = np.nonzero(x[at : min(at + step, hi)] @ matrix.T >= low)
                    p, q = own[at - lo + i], codes[j]
                    ok = p != q
                    if ok.any():
                        both = np.unique(np.minimum(p[ok], q[ok]) * np.int64(1 << 32) + np.maximum(p[ok], q[ok]))
                        ends.append((both >> 32, both & ((1 << 32) - 1)))
                if sum(len(e[0]) for e in ends) > 4_000_000:  # keep a forest only
                    i, j = forest(np.arange(len(known)), *(np.concatenate(e) for e in zip(*ends, strict=True)))
                    ends[:] = [(i, j)]
        if (done := settle()) is not None:
            yield done

    tiles = tiles.repartitionById(across * down, F.col("tile")).sortWithinPartitions("tile", "kind")
    return tiles.mapInArrow(run, "a string, b string").distinct()


def _far_links(tagged: DataFrame, comp: DataFrame, n: int, cores: np.ndarray, first: np.ndarray, low: np.float32, block: int, dim: int) -> DataFrame | None:
    """Links between core groups of different components through rows that come near one group only.

    A row outside the largest component is compared with all such rows if it can link to one
    of them: with a core of the other's group at angle d at least, and the group's rows at
    angles of at most r from their cores, that needs d at most r plus the angle of a link.
    """
    far = tagged.where("part >= 0 and not near")
    held = far.groupBy("part").agg(F.count("*").alias("n"), F.min("close").alias("close")).collect()  # one row per core group
    label = np.array([f"\x01{i}" for i in range(n)], object)
    for r in comp.where(F.col("vertex").startswith("\x01")).collect():
        label[int(r.vertex[1:])] = r.component
    code = np.unique(label.astype(str), return_inverse=True)[1]
    reach, rows = np.full(n, -np.inf), np.zeros(n, np.int64)
    for r in held:
        reach[r.part] = np.arccos(np.clip(r.close, -1, 1)) + np.arccos(np.clip(float(low), -1, 1)) + 1e-3
        rows[r.part] = r.n
    held_by = np.bincount(code, weights=rows)
    if (held_by > 0).sum() < 2:
        return None
    largest = int(np.argmax(held_by))
    ask, named = "node string, salt long, v binary", [str(x) for x in label]

    def with_component(only_asking: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, part = vector_rows(b.column("v"), dim), b.column("part").to_numpy()
                mine, ok = code[part], np.ones(len(part), bool)
                for lo in range(0, len(x) if only_asking else 0, 2048):
                    best = np.maximum.reduceat(x[lo : lo + 2048] @ cores.T, first, axis=1)
                    own = mine[lo : lo + 2048]
                    ok[lo : lo + 2048] = (own != largest) & ((np.arccos(np.clip(best, -1, 1)) <= reach) & (code[None, :] != own[:, None])).any(1)
                keep = pa.array(ok)
                yield pa.RecordBatch.from_arrays([pa.array([named[p] for p in part[ok]], pa.string()), b.column("salt").filter(keep), b.column("v").filter(keep)], ["node", "salt", "v"])

        return run

    far = far.select("part", F.xxhash64("id").alias("salt"), "v")
    asking = materialize(far.mapInArrow(with_component(True), ask), "cl-far")
    found = _tile_links(asking, far.mapInArrow(with_component(False), ask), low, block, dim)
    return materialize(found, "cl-far-links")


def link_clusters(
    vectors: DataFrame,
    min_cosine: float = 0.6,
    least: int = 5,
    k: int | None = None,
    core: int = 32,
    border: float = 0.45,
    block: int = 131_072,
    dim: int = 64,
    seed: int = 5,
) -> DataFrame:
    """Clusters of rows joined by links of ``min_cosine``: ``(id, cluster)`` for clusters of ``least`` rows or more.

    ``vectors`` is ``(id, v)`` with unit vectors as bytes, one row per id; ``cluster`` is the
    smallest id of the cluster. ``k`` is a quarter of the square root of the rows unless given. Rows of smaller clusters and an empty table give no rows.
    """
    spark = vectors.sparkSession
    vectors = materialize(vectors, "cl-vectors")
    if k is None:
        k = int(np.clip(np.sqrt(vectors.count()) / 4, MIN_K, MAX_K))
    centres = kmeans(vectors, k, dim, seed=seed)
    if not len(centres):
        return spark.createDataFrame([], "id string, cluster string")
    cores = typical(assign(vectors, centres, dim), "cell", core).orderBy("cell", "place").collect()
    m = np.stack([np.frombuffer(bytes(r.v), np.float32) for r in cores])
    low = np.float32(min_cosine - 1e-7)
    a, b = np.nonzero(m @ m.T >= low)
    part = _roots(len(m), a, b)
    names, part = np.unique(part, return_inverse=True)
    starts = np.argsort(part, kind="stable")
    first = np.searchsorted(part[starts], np.arange(len(names)))
    ordered = m[starts]

    def to_cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``part``: the first core group linked (-1: none), ``close``: its best cosine; ``also``: further ones; ``near``: whether a group comes near without a link."""
        for b in batches:
            x = vector_rows(b.column("v"), dim)
            own, also, near, close = np.full(len(x), -1, np.int32), [None] * len(x), np.zeros(len(x), bool), np.zeros(len(x))
            for lo in range(0, len(x), 2048):
                best = np.maximum.reduceat(x[lo : lo + 2048] @ ordered.T, first, axis=1)
                linked = best >= low
                some = linked.any(1)
                own[lo : lo + 2048][some] = np.argmax(linked[some], 1)
                close[lo : lo + 2048][some] = best[some, np.argmax(linked[some], 1)]
                near[lo : lo + 2048] = ~some | ((best >= border) & ~linked).any(1)
                for r in np.flatnonzero(linked.sum(1) > 1):
                    also[lo + r] = np.flatnonzero(linked[r])[1:].astype(np.int32).tolist()
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(own), pa.array(also, pa.list_(pa.int32())), pa.array(near), pa.array(close)], ["id", "v", "part", "also", "near", "close"])

    tagged = materialize(vectors.mapInArrow(to_cores, "id string, v binary, part int, also array<int>, near boolean, close double"), "cl-tagged")
    joins = tagged.where("also is not null").select("part", F.explode("also").alias("other")).distinct().collect()  # pairs of core groups
    node = F.when(F.col("part") >= 0, F.concat(F.lit("\x01"), F.col("part").cast("string"))).otherwise(F.col("id"))
    edges = spark.createDataFrame([("\x01" + str(r.part), "\x01" + str(r.other)) for r in joins], "a string, b string")
    nodes = tagged.select(node.alias("node"), F.xxhash64("id").alias("salt"), "v", "near")
    found = materialize(_tile_links(nodes.where("near").drop("near"), nodes.drop("near"), low, block, dim), "cl-links")
    edges = edges.unionByName(found)
    comp = connected_components(edges)
    merged = _far_links(tagged, comp, len(names), ordered, first, low, block, dim)
    if merged is not None and not merged.isEmpty():
        comp = connected_components(edges.unionByName(merged))
    named = tagged.select("id", node.alias("node")).join(comp.withColumnRenamed("vertex", "node"), "node", "left")
    named = materialize(named.select("id", F.coalesce("component", "node").alias("c")), "cl-named")
    sizes = named.groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("cluster")).where(F.col("n") >= least)
    return named.join(sizes, "c").select("id", "cluster")


def describe(vectors: DataFrame, clusters: DataFrame, dim: int = 64, members: int = 5) -> DataFrame:
    """``(cluster, size, typical)``: how many rows, and the ids nearest the cluster's centre, nearest first."""
    both = materialize(vectors.join(clusters, "id"), "cl-members")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("cluster"), pa.array(np.ones(b.num_rows, np.int64)), _doubles(vector_rows(b.column("v"), dim).astype(np.float64))], ["cluster", "n", "s"])

    centre = _sum_vectors(both.select("cluster", "v").mapInArrow(arrays, "cluster string, n long, s array<double>"), "cluster", dim)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, c = vector_rows(b.column("v"), dim), b.column("s").flatten().to_numpy().reshape(b.num_rows, dim)
            cos = (x * c).sum(1) / np.maximum(np.sqrt((c * c).sum(1)), 1e-12)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("cluster"), pa.array(np.round(cos, 6))], ["id", "cluster", "near"])

    scored = both.join(centre.select("cluster", "s"), "cluster").select("id", "cluster", "v", "s").mapInArrow(near, "id string, cluster string, near double")
    top = typical(scored, "cluster", members).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("t"))
    return centre.select("cluster", F.col("n").alias("size")).join(top, "cluster").select("cluster", "size", F.col("t.id").alias("typical"))

"""Near-duplicate texts with small edits, by tiled exclusive-or of shingle fingerprints.

Every text becomes its set of word shingles, and the set an odd sketch: a bit string in
which each shingle flips one bit. The exclusive-or of two sketches is the sketch of the
symmetric difference, so its bit count is never more than the true difference, and

    jaccard >= t   <=>   |A xor B| <= (1 - t) / (1 + t) * (|A| + |B|)

makes the right side a radius within which the bit count must fall. Tiles of sketches,
ordered by the population count of the shingle sets, are compared with numpy exclusive-or
and bit counts; tile pairs whose population counts differ beyond the radius are skipped.
What passes is verified on the shingle sets themselves, so no reported pair is a guess.

Comparing all tiles with all tiles is quadratic in the collection: that is the exact way
(``exact=True``). Otherwise tiles are formed within MinHash bands (``bands`` of ``rows``
values): a pair of texts with similarity s shares a band with probability
1 - (1 - s**rows)**bands, and every pair that does is compared.

Scale: band values travel first, without sketches, and only what shares a band with another
text goes on. Exact copies collapse to one class before they are compared; a band value that holds many
classes (found on a deterministic sample, so that only the layout depends on it) is split
into tile pairs that go to different tasks. Nothing about all texts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.words import ALNUM_, Words, mix, pieces
from gleaner.operators.graph import connected_components
from gleaner.runtime import drop_materialized, materialize, spread

SKETCH_BITS = 256
TILE = 1024
#: A band value is split if a sample of one class in SAMPLE suggests more than HOT classes.
SAMPLE, HOT = 32, 4096
#: Classes in a tile of the exact way.
EXACT_TILE = 8192
#: Bytes of each shingle's hash that are kept for verification.
KEPT = 5
#: Copies of two linked texts (or of one) are written out pair by pair up to this many pairs.
EXPAND = 1 << 16
#: Candidate ids are broadcast up to this many; beyond it they are shuffled.
BROADCAST_IDS = 200_000

_BIN = "binary"


def _fixed(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _unfixed(column: pa.Array, width: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.empty((0, width), np.uint8)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), width)


def _sorted_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all rows one after the other, and where each row's begin."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.empty(0, np.uint8)
    wide = np.zeros((len(data) // KEPT, 8), np.uint8)
    wide[:, :KEPT] = data.reshape(-1, KEPT)
    return wide.view(np.uint64).reshape(-1), (offsets - offsets[0]) // KEPT


def _sets(texts: list[str], shingle: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc``, first position of each doc's shingles and the sorted distinct shingle hashes; only texts of ``least`` words."""
    w = Words(texts, ALNUM_)
    doc, _, h = w.runs(shingle)
    n = np.bincount(w.doc, minlength=len(texts)) if len(w.doc) else np.zeros(len(texts), np.int64)
    keep = n[doc] >= least
    doc, h = doc[keep], h[keep]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.empty(0, np.int64)
    return doc, first, h


def _texts(df: DataFrame, id_col: str, group_col: str, text_col: str) -> DataFrame:
    cols = df.select(F.col(id_col).cast("string").alias("id"), F.col(group_col).cast("string").alias("grp"), F.col(text_col).cast("string").alias("t"))
    return spread(cols.where(F.col("id").isNotNull() & F.col("t").isNotNull()))


def class_keys(texts: DataFrame, shingle: int, least: int) -> DataFrame:
    """``(id, grp, k1, k2)`` of every text ``(id, grp, t)`` with at least ``least`` words; ``(k1, k2)`` identify its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("t").to_pylist()
            for lo, hi in pieces(texts):
                doc, first, h = _sets(texts[lo:hi], shingle, least)
                if len(first):
                    k1, k2 = _set_keys(first, h)
                    take = pa.array(doc[first] + lo)
                    yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("grp").take(take), pa.array(k1), pa.array(k2)], ["id", "grp", "k1", "k2"])

    return texts.mapInArrow(run, "id string, grp string, k1 long, k2 long")


def _set_keys(first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k1 = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), first)
    k2 = np.add.reduceat(mix(h ^ np.uint64(0x14057B7EF767814F)), first)
    return k1.view(np.int64), k2.view(np.int64)


def _fresh(seen: set[int], k1: np.ndarray) -> np.ndarray:
    """Positions of the values that this task has not met before."""
    at = [i for i, k in enumerate(k1.tolist()) if not (k in seen or seen.add(k))]
    return np.array(at, np.int64)


def sketches(texts: DataFrame, shingle: int, least: int) -> DataFrame:
    """``(k1, size, sketch)``; a class has at most one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            texts = b.column("t").to_pylist()
            for lo, hi in pieces(texts):
                _, first, h = _sets(texts[lo:hi], shingle, least)
                if not len(first):
                    continue
                k1, size = _set_keys(first, h)[0], np.diff(np.append(first, len(h)))
                at = np.repeat(np.arange(len(first)), size)
                flips = np.bincount(at * SKETCH_BITS + (h & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=len(first) * SKETCH_BITS)
                sketch = np.packbits((flips & 1).astype(np.uint8).reshape(len(first), SKETCH_BITS), axis=1)
                new = _fresh(seen, k1)
                yield pa.RecordBatch.from_arrays([pa.array(k1[new]), pa.array(size[new].astype(np.int32)), _fixed(sketch[new])], ["k1", "size", "sketch"])

    return texts.mapInArrow(run, f"k1 long, size int, sketch {_BIN}")


def band_keys(texts: DataFrame, shingle: int, least: int, bands: int, rows: int, seed: int) -> DataFrame:
    """``(key, k1)``: the ``bands`` band values of each class, at most once a task."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            texts = b.column("t").to_pylist()
            for lo, hi in pieces(texts):
                _, first, h = _sets(texts[lo:hi], shingle, least)
                if not len(first):
                    continue
                k1 = _set_keys(first, h)[0]
                keys = np.zeros((len(first), bands), np.uint64)
                for i, a in enumerate(odd):
                    low = np.minimum.reduceat((h * a) >> np.uint64(32), first)
                    keys[:, i // rows] = mix(keys[:, i // rows] + low + np.uint64(i + 1))
                new = _fresh(seen, k1)
                yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64).reshape(-1)), pa.array(np.repeat(k1[new], bands))], ["key", "k1"])

    return texts.mapInArrow(run, "key long, k1 long")


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(key, k1)`` in that order: distinct ones whose key several classes have."""
    last: tuple[int, int] | None = None  # the row that may be the first of its key
    told = False
    for b in batches:
        if not b.num_rows:
            continue
        key, k1 = b.column("key").to_numpy(), b.column("k1").to_numpy()
        if last is not None:
            key, k1 = np.append(last[0], key), np.append(last[1], k1)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (k1[1:] != k1[:-1])
        key, k1 = key[new], k1[new]
        same = key[1:] == key[:-1]
        keep = np.append(False, same) | np.append(same, False)
        if told:
            keep[0] = False
        last, told = (int(key[-1]), int(k1[-1])), bool((keep[-1] and len(key) > 1) or (told and len(key) == 1))
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(k1[keep])], ["key", "k1"])


def compare_tiles(a: tuple, b: tuple, ratio: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two tiles ``(size, sketch words)``, each in order of size, whose sketches differ within the radius."""
    (sa, xa), (sb, xb) = a, b
    # |A| and |B| alone differ by at least ||A| - |B||: skip the tile pair if that exceeds the radius everywhere
    if max(int(sa[0]) - int(sb[-1]), int(sb[0]) - int(sa[-1])) > ratio * (int(sa[-1]) + int(sb[-1])):
        none = np.empty(0, np.int64)
        return none, none
    total = sa[:, None].astype(np.int64) + sb[None, :]
    near = np.abs(sa[:, None].astype(np.int64) - sb[None, :]) <= ratio * total
    if same:
        near &= np.arange(len(sa))[:, None] < np.arange(len(sb))[None, :]
    i, j = np.nonzero(near)
    differ = np.zeros(len(i), np.int64)
    for word in range(xa.shape[1]):
        differ += np.bitwise_count(xa[i, word] ^ xb[j, word])
    keep = differ <= ratio * total[i, j]
    return i[keep], j[keep]


def _compare_group(size: np.ndarray, x: np.ndarray, tile: np.ndarray, wanted: tuple[int, int], ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers within one bucket; ``tile`` tells the two sides of a split bucket apart."""
    sides = [np.flatnonzero(tile == wanted[0]), np.flatnonzero(tile == wanted[1])]
    same = wanted[0] == wanted[1]
    sides = [s[np.argsort(size[s], kind="stable")] for s in sides]
    for p in range(0, len(sides[0]), TILE):
        for q in range(p if same else 0, len(sides[1]), TILE):
            a, b = sides[0][p : p + TILE], sides[1][q : q + TILE]
            i, j = compare_tiles((size[a], x[a]), (size[b], x[b]), ratio, same and p == q)
            if len(i):
                yield a[i], b[j]


def _pairs_in_buckets(ratio: float):
    """Rows sorted by bucket: small buckets compare all at once, large ones tile by tile."""

    def emit(k1: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch | None:
        a, b = k1[i], k1[j]
        keep = a != b
        lo, hi = np.minimum(a, b)[keep], np.maximum(a, b)[keep]
        if not len(lo):
            return None
        both = np.unique(np.stack([lo, hi], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def block(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, ti, tj, tile, k1, size = (rows[c] for c in ("key", "ti", "tj", "tile", "k1", "size"))
        x = rows["sketch"]
        change = np.flatnonzero((key[1:] != key[:-1]) | (ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1])) + 1
        first = np.append(0, change)
        n = np.diff(np.append(first, len(key)))
        small = (n > 1) & (n <= 64) & (ti[first] == tj[first])
        for width in np.unique(n[small]):  # buckets of one size together: every pair of positions at once
            at = first[small & (n == width)]
            pi, pj = np.triu_indices(int(width), 1)
            for part in range(0, len(at), max(1, 2_000_000 // len(pi))):
                base = at[part : part + max(1, 2_000_000 // len(pi)), None]
                i, j = (base + pi).reshape(-1), (base + pj).reshape(-1)
                total = size[i].astype(np.int64) + size[j]
                ok = np.abs(size[i].astype(np.int64) - size[j]) <= ratio * total
                i, j, total = i[ok], j[ok], total[ok]
                differ = np.zeros(len(i), np.int64)
                for word in range(x.shape[1]):
                    differ += np.bitwise_count(x[i, word] ^ x[j, word])
                ok = differ <= ratio * total
                if (out := emit(k1, i[ok], j[ok])) is not None:
                    yield out
        for g in np.flatnonzero((n > 1) & ~small):
            s = slice(first[g], first[g] + n[g])
            for i, j in _compare_group(size[s], x[s], tile[s], (int(ti[first[g]]), int(tj[first[g]])), ratio):
                if (out := emit(k1[s], i, j)) is not None:
                    yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        rows_held = 0
        for b in batches:
            rows = {c: b.column(c).to_numpy() for c in ("key", "ti", "tj", "tile", "k1", "size")}
            rows["sketch"] = _unfixed(b.column("sketch"), SKETCH_BITS // 8).view(np.uint64)
            held.append({c: v.copy() for c, v in rows.items()})
            rows_held += b.num_rows
            if rows_held < 200_000:
                continue
            joined = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            key, ti, tj = joined["key"], joined["ti"], joined["tj"]
            last = (key == key[-1]) & (ti == ti[-1]) & (tj == tj[-1])
            cut = int(np.argmax(last))  # the last bucket may go on in the next batch
            if cut:
                yield from block({c: v[:cut] for c, v in joined.items()})
                joined = {c: v[cut:] for c, v in joined.items()}
            held, rows_held = [joined], len(joined["key"])
        if rows_held:
            yield from block({c: np.concatenate([h[c] for h in held]) for c in held[0]})

    return run


def _band_tiles(banded: DataFrame, sampled: DataFrame, drawn: DataFrame) -> DataFrame:
    """``(key, ti, tj, tile, k1, size, sketch)``: classes that share a band value, large ones split into pairs of tiles."""
    hot = sampled.distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLE > HOT)
    hot = materialize(hot.select("key", F.ceil(F.col("n") * SAMPLE / (HOT // 2)).cast("int").alias("parts")), "nd-hot")
    n_hot = hot.count()
    zero = F.lit(0)
    if n_hot:
        pick = F.broadcast(hot) if n_hot <= BROADCAST_IDS else hot
        split = banded.join(pick, "key").distinct()
        banded = banded.join(pick, "key", "left_anti")
        tile = F.pmod(F.xxhash64("k1"), F.col("parts")).cast("int")
        split = split.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        split = split.select("key", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"), "tile", "k1")
    several = banded.repartition("key").sortWithinPartitions("key", "k1").mapInArrow(_shared_keys, "key long, k1 long")
    several = several.select("key", zero.alias("ti"), zero.alias("tj"), zero.alias("tile"), "k1")
    if n_hot:
        several = several.unionByName(split)
    return several.join(drawn, "k1").select("key", "ti", "tj", "tile", "k1", "size", "sketch")


def _all_tiles(drawn: DataFrame, ratio: float) -> DataFrame:
    """The same for all classes in order of size: every pair of tiles whose sizes do not exclude a link."""
    counts = drawn.groupBy("size").agg(F.count("*").alias("n")).orderBy("size").toPandas()  # one row per size
    size, n = counts["size"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    if not len(size):
        return drawn.select(*(F.lit(0).cast(t).alias(c) for c, t in (("key", "long"), ("ti", "int"), ("tj", "int"), ("tile", "int"))), "k1", "size", "sketch")
    done = np.cumsum(n) - n
    low, high = done // EXACT_TILE, (done + n - 1) // EXACT_TILE  # tiles that hold classes of each size
    tiles = int(high[-1]) + 1
    smallest, largest = size[np.searchsorted(high, np.arange(tiles), "left")], size[np.searchsorted(low, np.arange(tiles), "right") - 1]
    # |A| and |B| differ by at least the radius beyond this reach
    least = np.searchsorted(largest, (1 - ratio) / (1 + ratio) * smallest - 1e-6, "left")
    most = np.searchsorted(smallest, (1 + ratio) / (1 - ratio) * largest + 1e-6, "right") - 1 if ratio < 1 else np.full(tiles, tiles - 1)
    spark = drawn.sparkSession
    placed = spark.createDataFrame([(int(s), int(d), int(c)) for s, d, c in zip(size, done, n, strict=True)], "size int, done long, n long")
    reach = spark.createDataFrame([(t, int(least[t]), int(most[t])) for t in range(tiles)], "tile int, lo int, hi int")
    rows = drawn.join(placed, "size").withColumn("tile", F.floor((F.col("done") + F.pmod(F.xxhash64("k1"), F.col("n"))) / EXACT_TILE).cast("int")).join(reach, "tile")
    rows = rows.withColumn("other", F.explode(F.sequence("lo", "hi")))
    return rows.select(F.lit(0).cast("long").alias("key"), F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"), "tile", "k1", "size", "sketch")


def similar_sets(
    df: DataFrame,
    id_col: str,
    group_col: str,
    text_col: str,
    threshold: float = 0.8,
    shingle: int = 5,
    least: int = 20,
    bands: int = 28,
    rows: int = 3,
    seed: int = 7,
    exact: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Classes of equal shingle sets, and the pairs of classes with Jaccard ``threshold`` or more.

    Returns ``members (k1, k2, id, grp, shared)``, one row per id (``shared``: whether its class
    has other members or links), and ``links (a1, a2, b1, b2, jaccard)``. ``exact`` compares all
    tiles instead of those within bands, which misses nothing and takes quadratic time.
    Null ids, null texts and texts of fewer than ``least`` words take no part; repeated rows of
    an id count once; a null group is a group of its own. An empty table gives empty results.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    # shingles are computed where they are used: storing them would cost more disk than hashing costs time
    texts = _texts(df, id_col, group_col, text_col)
    members = ids = materialize(class_keys(texts, shingle, least).select("k1", "k2", "id", "grp").distinct(), "nd-ids")
    ratio = (1 - threshold) / (1 + threshold) + 1e-9  # rounding must not reject a pair at the threshold; what is too much is verified away
    drawn = sketches(texts, shingle, least).groupBy("k1").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    if exact:
        tiles = _all_tiles(materialize(drawn, "nd-sketches"), ratio)
    else:
        some = _texts(df.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(SAMPLE)) == 0), id_col, group_col, text_col)
        tiles = _band_tiles(band_keys(texts, shingle, least, bands, rows, seed), band_keys(some, shingle, least, bands, rows, seed), drawn)
    tiles = tiles.repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj")
    near = materialize(tiles.mapInArrow(_pairs_in_buckets(ratio), "a long, b long").distinct(), "nd-candidates")
    # verify on the shingle sets of one text per class that has a candidate
    paired = near.select(F.col("a").alias("k1")).unionByName(near.select(F.col("b").alias("k1"))).distinct()
    reps = members.groupBy("k1", "k2").agg(F.min("id").alias("id"))
    wanted = materialize(reps.join(paired, "k1", "left_semi").select("k1", "k2", F.col("id").alias("_id")), "nd-wanted")
    pick = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    whole = df.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("string").alias("_t")).where(F.col("_t").isNotNull()).join(pick, "_id")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column("_t").to_pylist()
            for lo, hi in pieces(t):
                doc, first, h = _sets(t[lo:hi], shingle, least)
                if len(first):
                    take = pa.array(doc[first] + lo)
                    packed = np.ascontiguousarray((h >> np.uint64(64 - 8 * KEPT)).view(np.uint8).reshape(-1, 8)[:, :KEPT])
                    offsets = (np.append(first, len(h)) * KEPT).astype(np.int32)
                    sets = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
                    yield pa.RecordBatch.from_arrays([b.column("k1").take(take), b.column("k2").take(take), sets], ["k1", "k2", "s"])

    sets = whole.select("k1", "k2", "_t").mapInArrow(shingled, f"k1 long, k2 long, s {_BIN}").dropDuplicates(["k1", "k2"])
    sets = materialize(sets, "nd-sets")
    left = sets.select(F.col("k1").alias("a"), F.col("k2").alias("a2"), F.col("s").alias("sa"))
    right = sets.select(F.col("k1").alias("b"), F.col("k2").alias("b2"), F.col("s").alias("sb"))

    def jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (va, oa), (vb, ob) = (_sorted_sets(b.column(c)) for c in ("sa", "sb"))
            j = np.empty(b.num_rows)
            for i in range(b.num_rows):
                x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                common = len(np.intersect1d(x, y, assume_unique=True))
                j[i] = common / (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("a", "a2", "b", "b2")), pa.array(j)], ["a1", "a2", "b1", "b2", "jaccard"])

    checked = near.join(left, "a").join(right, "b").select("a", "a2", "b", "b2", "sa", "sb")
    links = checked.mapInArrow(jaccard, "a1 long, a2 long, b1 long, b2 long, jaccard double").where(F.col("jaccard") >= threshold)
    links = materialize(links, "nd-links")
    for done in (near, wanted, sets):
        drop_materialized(done)
    # few classes have copies or links: mark their members once, so that nothing later touches the rest
    ends = links.select(F.col("a1").alias("k1"), F.col("a2").alias("k2")).unionByName(links.select(F.col("b1").alias("k1"), F.col("b2").alias("k2")))
    several = members.groupBy("k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("k1", "k2")
    shared = ends.unionByName(several).distinct().withColumn("shared", F.lit(True))
    members = members.join(shared, ["k1", "k2"], "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    marked = materialize(members, "nd-members")
    drop_materialized(ids)
    return marked, links


def pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ids of different groups that the classes and links stand for.

    Copies of a text, and copies of two linked texts, are written out pair by pair while that
    makes at most ``EXPAND`` pairs. Beyond, a pair of representatives stands for the link, and each copy is
    paired once: with a representative of another group in its class or, if the class lies in
    one group, with one of a linked class. So every id that has a partner has a row, no link between different
    texts is lost, and with the classes that :func:`groups` names all pairs follow.
    """
    members = materialize(members.where("shared").drop("shared"), "nd-shared")
    count = members.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct("id", "grp")).alias("r1"))
    other = (
        members.join(count.where(F.col("n") > 1), ["k1", "k2"])
        .where(~F.col("grp").eqNullSafe(F.col("r1.grp")))
        .groupBy("k1", "k2")
        .agg(F.min(F.struct("id", "grp")).alias("r2"))
    )
    count = count.join(other, ["k1", "k2"], "left")
    differ = ~F.col("ga").eqNullSafe(F.col("gb"))
    within_reach = F.col("n") * F.col("n") <= EXPAND
    sized = members.join(count.where(F.col("r2").isNotNull()), ["k1", "k2"])
    small = sized.where(within_reach)
    one = small.select("k1", "k2", F.col("id").alias("x"), F.col("grp").alias("ga"))
    two = small.select("k1", "k2", F.col("id").alias("y"), F.col("grp").alias("gb"))
    within = one.join(two, ["k1", "k2"]).where((F.col("x") < F.col("y")) & differ).select("x", "y")
    large = sized.where(~within_reach)
    star = large.select(F.col("id").alias("y"), F.when(F.col("grp").eqNullSafe(F.col("r1.grp")), F.col("r2.id")).otherwise(F.col("r1.id")).alias("x"))
    na = count.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("n").alias("na"), F.col("r1").alias("ra"), F.col("r2").alias("ra2"))
    nb = count.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("n").alias("nb"), F.col("r1").alias("rb"), F.col("r2").alias("rb2"))
    linked = links.join(na, ["a1", "a2"]).join(nb, ["b1", "b2"])
    few, many = linked.where(F.col("na") * F.col("nb") <= EXPAND), linked.where(F.col("na") * F.col("nb") > EXPAND)
    ma = members.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("id").alias("x"), F.col("grp").alias("ga"))
    mb = members.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("id").alias("y"), F.col("grp").alias("gb"))
    across = few.select("a1", "a2", "b1", "b2").join(ma, ["a1", "a2"]).join(mb, ["b1", "b2"]).where(differ).select("x", "y")
    both = many.select(F.explode(F.array("ra", "ra2")).alias("p"), "a1", "a2", "ra2", "b1", "b2", "rb", "rb2")
    both = both.select("p", F.explode(F.array("rb", "rb2")).alias("q"), "a1", "a2", "ra2", "b1", "b2", "rb2")
    both = both.where(F.col("p").isNotNull() & F.col("q").isNotNull() & ~F.col("p.grp").eqNullSafe(F.col("q.grp")))
    reps = both.select(F.col("p.id").alias("x"), F.col("q.id").alias("y"))
    # copies that all lie in one group: each with one representative of one linked class of another group
    sides = both.where("ra2 is null").select(F.col("a1").alias("k1"), F.col("a2").alias("k2"), F.col("q.id").alias("x"))
    sides = sides.unionByName(both.where("rb2 is null").select(F.col("b1").alias("k1"), F.col("b2").alias("k2"), F.col("p.id").alias("x")))
    attached = members.join(sides.groupBy("k1", "k2").agg(F.min("x").alias("x")), ["k1", "k2"]).select("x", F.col("id").alias("y"))
    every = within.unionByName(star.select("x", "y")).unionByName(across).unionByName(reps).unionByName(attached)
    return every.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per id: ``(id, grp, group_id, class_id, links)``, texts joined through links directly or through others.

    ``group_id`` is the smallest id of the group, ``class_id`` the smallest of those with the same
    set of shingles; ``links`` counts the other classes that the
    id's class is linked to. Ids without a partner form a group of their own.
    """
    key = lambda a, b: F.concat_ws(":", F.col(a), F.col(b))
    alone = members.where(~F.col("shared")).select("id", "grp", F.col("id").alias("group_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    members = members.where("shared").withColumn("c", key("k1", "k2"))
    edges = links.select(key("a1", "a2").alias("a"), key("b1", "b2").alias("b"))
    comp = connected_components(edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("links"))
    classes = members.groupBy("c").agg(F.min("id").alias("class_id")).join(comp.withColumnRenamed("vertex", "c"), "c", "left").join(degree, "c", "left")
    classes = materialize(classes.select("c", "class_id", F.coalesce("component", "c").alias("component"), F.coalesce("links", F.lit(0)).cast("long").alias("links")), "nd-classes")
    first = classes.groupBy("component").agg(F.min("class_id").alias("group_id"))
    named = members.join(classes.join(first, "component"), "c")
    return named.select("id", "grp", "group_id", "class_id", "links").unionByName(alone)

"""Corpus analytics over stored vectors: centroids, duplicates, cleanup, topics and categories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.graph import connected_components
from gleaner.operators.vector_join import similarity_join
from gleaner.runtime import materialize


def file_centroids(chunks: DataFrame, path_col: str = "file_path", vec_col: str = "embedding", dim: int = 64) -> DataFrame:
    """``(path, centroid)``: the element-wise mean of a file's vectors at unit length; a zero mean stays zero.

    One aggregation whose sums are combined before the shuffle. Null paths and vectors that
    are null or of another length take no part.
    """
    rows = chunks.select(F.col(path_col).alias("path"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("path").isNotNull() & (F.size("v") == dim))
    means = rows.groupBy("path").agg(*(F.avg(F.col("v")[i]).alias(f"v{i}") for i in range(dim)))
    means = means.select("path", F.array(*(f"v{i}" for i in range(dim))).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    means = means.withColumn("n", length)
    return means.select("path", F.when(F.col("n") > 0, F.transform("v", lambda x: x / F.col("n"))).otherwise(F.col("v")).alias("centroid"))


def duplicate_pairs(centroids: DataFrame, threshold: float = 0.95, dim: int = 64) -> tuple[DataFrame, DataFrame]:
    """Pairs of files with cosine ``threshold`` or more; see :func:`similarity_join`."""
    return similarity_join(centroids, "path", "centroid", threshold, dim)


def _greedy_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by component, kind and path: members (kind 0), then what each path may be paired with (kind 1).

    What is used of a class is always the front of its paths: an earlier path left over would
    have taken a later one of its class.
    """
    component, held, head = None, {}, {}
    path, own, best = None, None, None
    out: list[tuple[str, str, float]] = []

    def settle() -> None:
        if best is not None:
            out.append((path, best[0], best[2]))
            head[own] += 1
            head[best[1]] += 1

    for b in batches:
        for c, kind, p, cls, other, cosine in zip(*(b.column(n).to_pylist() for n in ("component", "kind", "path", "class", "other", "cosine")), strict=True):
            if c != component or p != path:
                settle()
                path, own, best = p, cls, None
                if c != component:
                    component, held, head = c, {}, {}
            if kind == 0:
                held.setdefault(cls, []).append(p)
                head[cls] = 0
                continue
            mine, theirs = held[cls], held[other]
            at = head[other] + (other == cls)
            if head[cls] < len(mine) and mine[head[cls]] == p and at < len(theirs) and (best is None or theirs[at] < best[0]):
                best = (theirs[at], other, cosine)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.float64())], ["a", "b", "cosine"])
            out.clear()
    settle()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.float64())], ["a", "b", "cosine"])


def greedy_groups(pairs: DataFrame, sizes: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """``(representative, duplicate, cosine, wasted)``: pairs in path order, each file used at most once.

    ``pairs (a, b, cosine)`` and ``sizes (path, size)``. ``members (id, class)`` adds the files
    that share a direction with the one in the pair: they pair with each other, at cosine 1,
    and with whatever their class pairs with. The larger file of a pair represents it, ties the
    first path. The greedy choice in the order ``(a, b)`` is one scan per connected component,
    so long chains and large groups end; a task holds the paths of one component at a time and
    streams the pairs past them. Pairs between classes are never written out file by file.
    """
    pairs = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max(F.col("cosine").cast("double")).alias("cosine"))
    pairs = materialize(pairs.where(F.col("a") != F.col("b")), "gg-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    named = ends.select(F.col("class").alias("path"), "class")
    if members is not None:
        files = members.groupBy(F.col("id").alias("path")).agg(F.min("class").alias("class"))
        named = files.unionByName(named.join(files.select("path"), "path", "left_anti"))
    classes = named.groupBy("class").agg(F.count("*").alias("n"), F.max("path").alias("last")).join(ends.withColumn("paired", F.lit(True)), "class", "left")
    classes = classes.where((F.col("n") > 1) | F.col("paired")).join(connected_components(pairs).withColumnRenamed("vertex", "class"), "class", "left")
    classes = materialize(classes.select("class", "n", "last", F.coalesce("component", "class").alias("component")), "gg-classes")
    named = materialize(named.join(classes.select("class", "component"), "class").select("component", "path", "class"), "gg-members")
    links = pairs.select(F.col("a").alias("class"), F.col("b").alias("other"), "cosine").unionByName(pairs.select(F.col("b").alias("class"), F.col("a").alias("other"), "cosine"))
    links = links.unionByName(classes.where("n > 1").select("class", F.col("class").alias("other"), F.lit(1.0).alias("cosine")))
    links = links.join(classes.select(F.col("class").alias("other"), "last"), "other")
    asks = named.join(links, "class").where(F.col("last") > F.col("path")).select("component", F.lit(1).alias("kind"), "path", "class", "other", "cosine")
    rows = named.select("component", F.lit(0).alias("kind"), "path", "class", F.lit(None).cast("string").alias("other"), F.lit(None).cast("double").alias("cosine")).unionByName(asks)
    rows = rows.repartition("component").sortWithinPartitions("component", "kind", "path")
    every = materialize(rows.mapInArrow(_greedy_scan, "a string, b string, cosine double"), "gg-taken")
    size = sizes.groupBy("path").agg(F.max("size").cast("long").alias("size"))
    every = every.join(size.select(F.col("path").alias("a"), F.col("size").alias("sa")), "a", "left").join(size.select(F.col("path").alias("b"), F.col("size").alias("sb")), "b", "left")
    swap = F.coalesce("sb", F.lit(0)) > F.coalesce("sa", F.lit(0))
    return every.select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("representative"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("duplicate"),
        "cosine", F.coalesce(F.when(swap, F.col("sa")).otherwise(F.col("sb")), F.lit(0)).cast("long").alias("wasted"),
    )


def duplicate_components(pairs: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """``(path, group_path)``: files joined by pairs directly or through others, named by the smallest path.

    ``members (id, class)`` adds the files that share a direction with the one in the pair.
    """
    edges = pairs.select("a", "b")
    if members is not None:
        edges = edges.unionByName(members.where("id != class").select(F.col("class").alias("a"), F.col("id").alias("b")))
    return connected_components(edges).select(F.col("vertex").alias("path"), F.col("component").alias("group_path"))


def duplicate_totals(groups: DataFrame) -> DataFrame:
    """``(groups, duplicates, wasted)`` of representative/duplicate rows, one row."""
    return groups.agg(F.count_distinct("representative").alias("groups"), F.count("*").alias("duplicates"), F.coalesce(F.sum("wasted"), F.lit(0)).alias("wasted"))


def cleanup_candidates(files: DataFrame, groups: DataFrame | None = None, now: str | None = None, stale_days: int | None = 365, temporary: bool = True, empty: bool = True, generated: bool = True) -> DataFrame:
    """``(path, reason, size, other)``: duplicates, empty, temporary, generated and stale files.

    ``files (path, size_bytes, modified_at)``; of several rows of a path the latest counts. A
    path has one row, for the first reason that holds in the order above. ``now`` is the time
    against which staleness is measured; without it no file is stale.
    """
    latest = files.where(F.col("path").isNotNull()).groupBy("path").agg(F.max(F.struct("modified_at", "size_bytes")).alias("f")).select("path", "f.*")
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    reason = F.lit(None).cast("string")
    if now is not None and stale_days is not None:
        reason = F.when(F.col("modified_at") < F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(stale_days)), F.lit("stale")).otherwise(reason)
    if generated:
        reason = F.when(F.col("path").rlike(r"(^|/)(build|dist|target|out|node_modules|__pycache__)/") | name.rlike(r"\.(o|pyc|class|min\.js|min\.css)$"), F.lit("generated")).otherwise(reason)
    if temporary:
        reason = F.when(name.rlike(r"(\.(tmp|temp|bak|swp|orig)|~)$"), F.lit("temporary")).otherwise(reason)
    if empty:
        reason = F.when(F.col("size_bytes") == 0, F.lit("empty")).otherwise(reason)
    other = F.lit(None).cast("string")
    if groups is not None:
        dup = groups.groupBy(F.col("duplicate").alias("path")).agg(F.min("representative").alias("other"))
        latest = latest.join(dup, "path", "left")
        reason = F.when(F.col("other").isNotNull(), F.lit("duplicate")).otherwise(reason)
        other = F.col("other")
    out = latest.select("path", reason.alias("reason"), F.col("size_bytes").alias("size"), other.alias("other"))
    return out.where(F.col("reason").isNotNull())


def global_index(df: DataFrame, order: str) -> DataFrame:
    """``df`` with a 0-based ``position`` in the order of a column, without one task holding all rows."""
    sorted_df = materialize(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()), "gi-sorted")
    counts = sorted_df.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return sorted_df.withColumn("_r", within).join(F.broadcast(offsets), "_p").withColumn("position", F.col("_r") + F.col("_o")).drop("_p", "_r", "_o")


def kmeans_topics(vectors: DataFrame, id_col: str, vec_col: str, max_groups: int = 10, rounds: int = 5, dim: int = 64) -> tuple[DataFrame, np.ndarray]:
    """Spherical k-means: ``(id, topic, similarity)`` and the centroids.

    Started from evenly spaced rows in order of id, a fixed number of rounds, ties to the lower
    topic, an empty topic keeps its centroid. Each round is one pass that sends a partial sum
    per topic. Null ids, null vectors and vectors of another length take no part.
    """
    if max_groups < 1:
        raise ValueError("max_groups must be at least 1")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dim))
    rows = materialize(global_index(rows, "id"), "km-rows")
    n = rows.count()
    id_type = rows.schema["id"].dataType.simpleString()
    if n == 0:
        return spark.createDataFrame([], f"id {id_type}, topic int, similarity double"), np.empty((0, dim))
    k = min(max_groups, n)
    step = n // k if n > k else 1
    start = [i * min(step, n - 1) for i in range(k)]
    first = {r.position: r.v for r in rows.where(F.col("position").isin(start)).collect()}
    centres = np.array([first[p] for p in start], np.float64)

    def similarity(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        bottom = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((c * c).sum(1))[None, :]
        return np.where(bottom > 0, (x @ c.T) / np.where(bottom > 0, bottom, 1), 0.0)

    for _ in range(rounds):

        def partial(batches: Iterator[pa.RecordBatch], c: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            sums, count = np.zeros_like(c), np.zeros(len(c), np.int64)
            for b in batches:
                x = b.column("v").flatten().to_numpy().reshape(b.num_rows, dim)
                if len(x):
                    at = np.argmax(similarity(x, c), 1)
                    np.add.at(sums, at, x)
                    count += np.bincount(at, minlength=len(c))
            some = np.flatnonzero(count)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * np.int32(dim)), pa.array(sums[some].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), flat], ["topic", "n", "s"])

        got = rows.select("v").mapInArrow(partial, "topic long, n long, s array<double>").groupBy("topic").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dim)))
        for r in got.collect():
            mean = np.array(r[2:], np.float64) / r.n
            size = np.sqrt((mean * mean).sum())
            centres[r.topic] = mean / size if size > 0 else mean

    def assign(batches: Iterator[pa.RecordBatch], c: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy().reshape(b.num_rows, dim)
            s = similarity(x, c)
            at = np.argmax(s, 1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(at.astype(np.int32)), pa.array(s[np.arange(len(x)), at])], ["id", "topic", "similarity"])

    return rows.select("id", "v").mapInArrow(assign, f"id {id_type}, topic int, similarity double"), centres


def assign_categories(vectors: DataFrame, categories: dict[str, list[float]], id_col: str, vec_col: str, minimum: float = 0.3) -> DataFrame:
    """``(id, category, similarity)``: the nearest of a few named vectors, ties to the last; below the minimum no category."""
    from gleaner.functions.vectors import cosine, literal_vector

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("_v")).where(F.col("id").isNotNull())
    if not categories:
        return rows.select("id", F.lit(None).cast("string").alias("category"), F.lit(None).cast("double").alias("similarity"))
    scored = [F.struct(cosine(F.col("_v"), literal_vector(v)).alias("s"), F.lit(i).alias("i"), F.lit(name).alias("c")) for i, (name, v) in enumerate(categories.items())]
    rows = rows.select("id", F.array_max(F.array(*scored)).alias("b"))
    return rows.select("id", F.when(F.col("b.s") >= minimum, F.col("b.c")).alias("category"), F.col("b.s").alias("similarity"))


def corpus_stats(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """One row: distinct chunks and files, files by outcome, content bytes and the last indexing time."""
    c = chunks.agg(F.count_distinct("chunk_id").alias("chunks"))
    f = files.groupBy("path").agg(F.max(F.struct(F.coalesce("indexed_at", F.lit("1970-01-01").cast("timestamp")), "status", "size_bytes")).alias("f"))
    f = f.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum((F.col("f.status") == "indexed").cast("long")), F.lit(0)).alias("indexed"),
        F.coalesce(F.sum((F.col("f.status") == "error").cast("long")), F.lit(0)).alias("errors"),
        F.coalesce(F.sum("f.size_bytes"), F.lit(0)).alias("bytes"),
    )
    return c.crossJoin(f)  # one row each

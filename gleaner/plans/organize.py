"""Reviewable plans as tables of actions: folders to make, files to move or delete, each with a confidence and a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.paths import extension, file_name, in_scope
from gleaner.operators.analytics import assign_categories, kmeans_topics

ACTION = "action string, source string, target string, confidence double, reason string"


def _mkdir(df: DataFrame, target: Column, confidence: float, reason: Column) -> DataFrame:
    return df.select(F.lit("mkdir").alias("action"), F.lit(None).cast("string").alias("source"), target.alias("target"), F.lit(confidence).alias("confidence"), reason.alias("reason"))


def _move(df: DataFrame, source: Column, target: Column, confidence: Column, reason: Column) -> DataFrame:
    moved = df.select(F.lit("move").alias("action"), source.alias("source"), target.alias("target"), confidence.alias("confidence"), reason.alias("reason"))
    return moved.where(F.col("source") != F.col("target"))


def _scoped(files: DataFrame, scope: str, *extra: str) -> DataFrame:
    """One row per path in scope (the largest values of the other columns, should they differ)."""
    rows = files.where(F.col("path").isNotNull() & in_scope(F.col("path"), scope))
    return rows.groupBy("path").agg(*(F.max(c).alias(c) for c in extra)) if extra else rows.select("path").distinct()


def by_type(files: DataFrame, scope: str) -> DataFrame:
    """A folder per extension (or major MIME type where there is none), and each file moved into its folder."""
    scope = scope.rstrip("/")
    rows = _scoped(files, scope, "mime_type")
    major = F.coalesce(F.nullif(F.element_at(F.split(F.coalesce("mime_type", F.lit("")), "/"), 1), F.lit("")), F.lit("other"))
    rows = rows.withColumn("kind", F.coalesce(F.nullif(extension(F.col("path")), F.lit("")), major))
    folder = F.concat(F.lit(scope + "/"), F.col("kind"))
    dirs = _mkdir(rows.select("kind").distinct(), folder, 1.0, F.concat(F.lit("folder for "), F.col("kind"), F.lit(" files")))
    moves = _move(rows, F.col("path"), F.concat(folder, F.lit("/"), file_name(F.col("path"))), F.lit(1.0), F.concat(F.lit("file type "), F.col("kind")))
    return dirs.unionByName(moves)


def by_project(files: DataFrame, scope: str) -> DataFrame:
    """A folder for each first path part below the scope that looks like one (no dot); nothing is moved."""
    scope = scope.rstrip("/")
    first = F.element_at(F.split(F.col("path").substr(F.lit(len(scope) + 2), F.char_length("path")), "/"), 1)
    names = _scoped(files, scope).select(first.alias("project")).where((F.col("project") != "") & ~F.col("project").contains(".")).distinct()
    return _mkdir(names, F.concat(F.lit(scope + "/"), F.col("project")), 0.8, F.concat(F.lit("project "), F.col("project")))


def by_topic(centroids: DataFrame, scope: str, max_groups: int = 10, threshold: float = 0.7, dim: int = 64) -> DataFrame:
    """A folder for every topic of a spherical k-means, and each file moved into its topic's folder."""
    scope = scope.rstrip("/")
    topics, centres = kmeans_topics(centroids.where(in_scope(F.col("path"), scope)), "path", "centroid", max_groups, dim=dim)
    names = topics.sparkSession.createDataFrame([(i + 1,) for i in range(len(centres))], "t int")
    folder = lambda t: F.concat(F.lit(scope + "/topic_"), t.cast("string"))
    dirs = _mkdir(names, folder(F.col("t")), 1.0, F.concat(F.lit("folder for topic "), F.col("t").cast("string")))
    target = F.concat(folder(F.col("topic") + 1), F.lit("/"), file_name(F.col("id")))
    moves = _move(topics, F.col("id"), target, F.greatest(F.col("similarity"), F.lit(threshold)), F.concat(F.lit("nearest topic "), (F.col("topic") + 1).cast("string")))
    return dirs.unionByName(moves)


def by_category(centroids: DataFrame, scope: str, categories: dict[str, list[float]], minimum: float = 0.3) -> DataFrame:
    """A folder per category, and each file moved to the nearest one if it is near enough."""
    scope = scope.rstrip("/")
    best = assign_categories(centroids.where(in_scope(F.col("path"), scope)), categories, "path", "centroid", minimum)
    names = best.sparkSession.createDataFrame([(c,) for c in categories], "c string")
    dirs = _mkdir(names, F.concat(F.lit(scope + "/"), F.col("c")), 1.0, F.concat(F.lit("folder for "), F.col("c")))
    best = best.where(F.col("category").isNotNull())
    target = F.concat(F.lit(scope + "/"), F.col("category"), F.lit("/"), file_name(F.col("id")))
    moves = _move(best, F.col("id"), target, F.col("similarity"), F.concat(F.lit("nearest category "), F.col("category")))
    return dirs.unionByName(moves)


def deletions(candidates: DataFrame) -> DataFrame:
    """Delete actions from cleanup candidates."""
    sure = F.when(F.col("reason").isin("duplicate", "empty"), F.lit(1.0)).otherwise(F.lit(0.5))
    return candidates.select(F.lit("delete").alias("action"), F.col("path").alias("source"), F.lit(None).cast("string").alias("target"), sure.alias("confidence"), "reason")


def impact(actions: DataFrame) -> DataFrame:
    """One row: how many files a plan touches, moves and deletes, and how many folders it makes."""
    n = lambda kind: F.coalesce(F.sum((F.col("action") == kind).cast("long")), F.lit(0))
    return actions.agg((n("move") + n("delete")).alias("files_affected"), n("mkdir").alias("dirs_created"), n("move").alias("files_moved"), n("delete").alias("files_deleted"))


def conflicts(actions: DataFrame, files: DataFrame) -> DataFrame:
    """``(target, sources, exists)`` of moves whose target several files claim or another file already has."""
    moves = actions.where("action = 'move'")
    claimed = moves.groupBy("target").agg(F.count("*").alias("sources"))
    taken = files.select(F.col("path").alias("target")).distinct().join(moves.select(F.col("source").alias("target")), "target", "left_anti").withColumn("exists", F.lit(True))
    both = claimed.join(taken, "target", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    return both.where((F.col("sources") > 1) | F.col("exists"))

"""The query language: words of text, and ``key:value`` filters, between white space."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.paths import glob_to_regex


@dataclass(frozen=True)
class Filter:
    """One predicate: ``kind`` is language, path, glob, mime, min_depth, max_depth, after or before."""

    kind: str
    value: object


@dataclass
class Query:
    text: str = ""
    filters: list[Filter] = field(default_factory=list)
    limit: int = 10
    metric: str = "cosine"


def parse(query: str, default_limit: int = 10, max_limit: int | None = None) -> Query:
    """Text, filters and limit of a query string.

    Keys are ``lang``/``language``, ``path`` (a glob if it holds ``*``, else a prefix),
    ``type``/``mime``, ``limit`` and ``depth``, in any case. Words with another key stay text;
    a value that is no number is dropped together with its key; the last limit counts.
    """
    words, filters, limit = [], [], default_limit
    for word in query.split():
        key, colon, value = word.partition(":")
        key = key.lower()
        if not colon:
            words.append(word)
        elif key in ("lang", "language"):
            filters.append(Filter("language", value))
        elif key == "path":
            filters.append(Filter("glob" if "*" in value else "path", value))
        elif key in ("type", "mime"):
            filters.append(Filter("mime", value))
        elif key == "limit":
            limit = int(value) if value.isascii() and value.isdigit() else limit
        elif key == "depth":
            if value.isascii() and value.isdigit() and int(value) < 256:
                filters.append(Filter("max_depth", int(value)))
        else:
            words.append(word)
    return Query(" ".join(words), filters, limit if max_limit is None else min(limit, max_limit))


def predicate(f: Filter) -> Column:
    """The filter over the columns of the chunks table (``modified_at`` comes from the files table)."""
    v = f.value
    if f.kind == "language":
        return F.col("language") == v
    if f.kind == "path":
        return F.col("file_path").startswith(str(v))
    if f.kind == "glob":
        return F.col("file_path").rlike(glob_to_regex(str(v)))
    if f.kind == "mime":
        return (F.col("file_mime_type") == v) | (F.col("content_type") == v) | F.col("content_type").startswith(f"{v}:")
    if f.kind == "max_depth":
        return F.col("depth") <= v
    if f.kind == "min_depth":
        return F.col("depth") >= v
    if f.kind in ("after", "before"):
        when = F.lit(v if isinstance(v, datetime) else str(v)).cast("timestamp")
        return F.col("modified_at") > when if f.kind == "after" else F.col("modified_at") < when
    raise ValueError(f"unknown filter {f.kind}")


def apply_filters(chunks: DataFrame, filters: list[Filter], files: DataFrame | None = None) -> DataFrame:
    """Chunks that pass every filter, before anything is scored; filters on time need ``files``."""
    if any(f.kind in ("after", "before") for f in filters):
        if files is None:
            raise ValueError("filters on modification time need the files table")
        times = files.groupBy(F.col("path").alias("_p")).agg(F.max("modified_at").alias("modified_at"))
        chunks = chunks.drop("modified_at").join(times, F.col("file_path") == F.col("_p")).drop("_p")
    for f in filters:
        chunks = chunks.where(predicate(f))
    return chunks

"""Column functions on ``array<float>`` vectors; all sums run left to right in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "dot")


def _double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _fold(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; null if either is null or the lengths differ."""
    return _fold(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(_fold(F.transform(_double(a), lambda x: x * x)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity, 0 for a null, a zero vector or vectors of different length."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def cosine_clamped(a: Column | str, b: Column | str) -> Column:
    return F.least(F.greatest(cosine(a, b), F.lit(-1.0)), F.lit(1.0))


def l2sq(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance; null if the lengths differ."""
    return _fold(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def l2_normalize(a: Column | str) -> Column:
    """The vector at unit length, as doubles; a zero vector stays zero."""
    v = _double(a)
    return F.transform(v, lambda x: x / F.greatest(norm(v), F.lit(1e-12)))


def metric_score(metric: str, a: Column | str, b: Column | str) -> Column:
    """Similarity where larger is closer: cosine, ``1 - squared distance`` or inner product."""
    if metric == "cosine":
        return cosine(a, b)
    if metric == "l2":
        return F.lit(1.0) - l2sq(a, b)
    if metric == "dot":
        return dot(a, b)
    raise ValueError(f"metric must be one of {METRICS}")


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def hash_embed(text: Column | str, dim: int = 384) -> Column:
    """A vector from the SHA-256 bytes of a text: ``byte / 255 - 0.5``, repeated to ``dim``; null stays null."""
    t = F.col(text) if isinstance(text, str) else text
    digest = F.sha2(t, 256)
    byte = lambda i: F.conv(F.substring(digest, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("double")
    return F.when(t.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (byte(i) / 255.0 - 0.5).cast("float")))


def literal_vector(values: list[float]) -> Column:
    """A constant vector, folded into the plan once."""
    return F.array(*(F.lit(float(x)) for x in values))

"""Vectors for texts: a small protocol, two model-free embedders, and embedding each distinct text once."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.vectors import hash_embed, zero_vector


class Embedder(Protocol):
    """What turns a text column into a vector column of ``dim`` floats."""

    dim: int
    name: str

    def embed(self, text: Column) -> Column: ...


class HashEmbedder:
    """Deterministic vectors from a digest of the text; equal texts get equal vectors."""

    name = "hash"

    def __init__(self, dim: int = 384):
        self.dim = dim

    def embed(self, text: Column) -> Column:
        return hash_embed(text, self.dim)


class ZeroEmbedder:
    """Zero vectors, for indexes that are searched by text only."""

    name = "zero"

    def __init__(self, dim: int = 384):
        self.dim = dim

    def embed(self, text: Column) -> Column:
        return F.when(text.isNotNull(), zero_vector(self.dim))


def mean_pool(states: np.ndarray, mask: np.ndarray, normalize: bool = True) -> np.ndarray:
    """Token states ``(batch, tokens, dim)`` averaged under a mask and scaled to unit length."""
    weight = mask[..., None].astype(np.float64)
    out = (states * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12) if normalize else out


class ModelEmbedder:
    """Any function from a list of texts to a matrix; it is loaded once per worker and called in batches."""

    def __init__(self, load, dim: int, name: str = "model", batch: int = 32):
        self.load, self.dim, self.name, self.batch = load, dim, name, batch

    def embed(self, text: Column) -> Column:
        load, batch = self.load, self.batch

        @F.pandas_udf("array<float>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for s in parts:
                out: list[np.ndarray | None] = [None] * len(s)
                some = [i for i, t in enumerate(s) if t is not None]
                for at in range(0, len(some), batch):
                    rows = some[at : at + batch]
                    for i, v in zip(rows, np.asarray(model([s.iloc[i] for i in rows]), np.float32), strict=True):
                        out[i] = v
                yield pd.Series(out)

        return run(text)


def embed_distinct(df: DataFrame, text_col: str, embedder: Embedder, out_col: str = "embedding", known: DataFrame | None = None) -> DataFrame:
    """``df`` with a vector column; each distinct text is embedded once.

    ``known`` is an optional table ``(text_hash, vector)`` of earlier runs; only texts that it
    lacks are embedded. Null texts get a null vector.
    """
    hashed = df.withColumn("_h", F.sha2(F.col(text_col), 256))
    texts = hashed.where(F.col("_h").isNotNull()).groupBy("_h").agg(F.min(text_col).alias("_t"))
    if known is not None:
        old = known.select(F.col("text_hash").alias("_h"), F.col("vector").alias("_v")).dropDuplicates(["_h"])
        fresh = texts.join(old, "_h", "left_anti").select("_h", embedder.embed(F.col("_t")).alias("_v"))
        vectors = old.unionByName(fresh)
    else:
        vectors = texts.select("_h", embedder.embed(F.col("_t")).alias("_v"))
    return hashed.drop(out_col).join(vectors, "_h", "left").withColumnRenamed("_v", out_col).drop("_h")


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))

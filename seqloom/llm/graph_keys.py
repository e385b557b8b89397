"""64-bit vertex keys for graphs whose vertices are strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.plans.stages import Stages

MAX_SEEDS = 16


def key(c: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), c)


def vertex_keys(edges: DataFrame, a: str, b: str, stages: Stages) -> tuple[DataFrame, int, int]:
    """``(key, id)`` of every vertex, the seed of its keys, and the number of vertices.

    The keys are hashes, checked to be without collision over all vertices; a seed with one is given up
    for the next.  So work on keys is exact.
    """
    for seed in range(MAX_SEEDS):
        ids = edges.select(F.explode(F.array(a, b)).alias("id")).distinct()
        vertices, n = stages.cut_counted(ids.select(key(F.col("id"), seed).alias("key"), "id"), "vertices")
        if n == vertices.agg(F.count_distinct("key")).head()[0]:
            return vertices, seed, n
        stages.drop(vertices)
    raise ValueError(f"{MAX_SEEDS} seeds in a row gave two vertices the same key")


def relabelled(c: Column, salt: int) -> Column:
    """A fresh order of the vertices.

    ``xxhash64`` of one 64-bit value under a fixed seed is made of invertible steps only, so it maps the
    64-bit values one to one: different vertices never get the same label.
    """
    return F.xxhash64(c.bitwiseXOR(F.lit(salt)))

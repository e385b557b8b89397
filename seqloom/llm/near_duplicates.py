"""Near-duplicate records with small edits: DartMinHash signatures, banded join, exact check.

The content of a record is its set of ``width`` consecutive letters (its shingles).  Records of equal text
are one class, so copies cost one signature.  Classes that agree in a whole band of their signatures are
candidates; every candidate pair is then compared by its exact shingle sets.

With ``r`` rows in each of ``b`` bands a pair of similarity s is missed with probability (1 - s^r)^b: at
the threshold of 0.6, r = 3 and b = 32 that is 0.04 %, and far less above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm import dart_minhash
from seqloom.llm.components import connected_components
from seqloom.plans.stages import Stages

#: Band rows of a shuffle partition on average: their number grows with the rows, a partition does not.
BAND_ROWS = 400_000


def letters(c: Column) -> Column:
    """The letters of a text, in upper case."""
    return F.upper(F.regexp_replace(c, r"[^\p{L}]+", ""))


def shingle_codes(texts: list[str], width: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit code) of every stretch of ``width`` characters; texts that are too short have none.

    Codes are hashes, alike in every call.  With ``exact`` different stretches have different codes, and
    codes compare only within the call: characters are numbered as they occur in the texts.
    """
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    length = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    if len(chars) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    n = len(chars) - width + 1
    code = np.zeros(n, dtype=np.uint64)
    if exact:
        seen = np.zeros(int(chars.max()) + 1, dtype=bool)
        seen[chars] = True
        found = int(seen.sum())
        if found**width >= 2**63:
            raise ValueError("too many different characters for exact codes")
        chars, base = (np.cumsum(seen) - 1).astype(np.uint64)[chars], np.uint64(found)
    else:
        base = np.uint64(0x100000001B3)
    for j in range(width):
        code = code * base + chars[j : j + n]
    if not exact:
        code = dart_minhash.mix(code)
    ends = np.cumsum(length)
    inside = np.ones(n, dtype=bool)
    for j in range(1, width):  # stretches that begin in the last letters of a text
        cut = ends - j
        inside[cut[(cut >= ends - length) & (cut < n)]] = False
    return np.repeat(np.arange(len(texts)), np.maximum(length - width + 1, 0)), code[inside]


def _sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The different shingles of every text in ascending order, as codes that are exact within the call."""
    try:
        _, code = shingle_codes(texts, width, exact=True)
    except ValueError:  # too many characters for 64 bits: number the shingles themselves
        parts = [[t[j : j + width] for j in range(len(t) - width + 1)] for t in texts]
        number = {x: i for i, x in enumerate(dict.fromkeys(x for p in parts for x in p))}
        code = np.array([number[x] for p in parts for x in p], dtype=np.uint64)
    ends = np.cumsum([max(0, len(t) - width + 1) for t in texts]).tolist()
    out = []
    for a, b in zip([0, *ends[:-1]], ends):
        x = np.sort(code[a:b])
        out.append(x[np.flatnonzero(np.append(x[1:] != x[:-1], True))] if b > a else x)
    return out


def _band_batches(width: int, n_bands: int, rows_per_band: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):  # keeps the darts in the cache
                part = batch.iloc[at : at + 256]
                row, code = shingle_codes(part["content"].tolist(), width)
                sig = dart_minhash.signatures(row, code, len(part), n_bands * rows_per_band)
                yield pd.DataFrame({"c": part["c"].to_numpy(), "bands": list(dart_minhash.bands(sig, rows_per_band).view(np.int64))})

    return run


def _pair_batches(width: int, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                # a text has several partners: its set is made once
                different = {t: i for i, t in enumerate(dict.fromkeys([*part["x"], *part["y"]]))}
                shingles = _sets(list(different), width)
                keep = []
                for x, y in zip(part["x"], part["y"]):
                    sx, sy = shingles[different[x]], shingles[different[y]]
                    both = np.concatenate((sx, sy))
                    both.sort()
                    common = np.count_nonzero(both[1:] == both[:-1])
                    keep.append(common >= threshold * (len(sx) + len(sy) - common) - 1e-9)
                yield part.loc[np.array(keep, dtype=bool), ["xh", "xg", "yh", "yg"]]

    return run


def near_duplicates(records: DataFrame, rec: str, content: Column, width: int = 5, threshold: float = 0.6, n_bands: int = 32, rows_per_band: int = 3) -> tuple[DataFrame, DataFrame]:
    """Pairs of similar classes ``(xh, xg, yh, yg)`` and membership ``(rec, h, g)`` of a table of texts.

    ``(h, g)`` names a class, the records of one and the same content, by two hashes (96 bits) of it.

    * A record is one (id, content); repeated rows count once.  Null ids and contents, and contents
      shorter than ``width``, are in no class.  Texts are used whole, whatever their length.
    * Similarity: shared shingles over all shingles of the pair, as sets, ``threshold`` or more.
    * Other columns are ignored, whatever their names.  Empty in, empty out.
    """
    stages = Stages(records.sparkSession, "near-duplicates")
    rows = records.select(F.col(rec).alias("rec"), content.alias("content")).where(
        F.col("rec").isNotNull() & (F.length("content") >= width)
    )
    hashed = rows.select("rec", F.xxhash64("content").alias("h"), F.hash("content").alias("g"), "content")
    # the number is written with the class: short and fixed from here on
    one = hashed.groupBy("h", "g").agg(F.min("content").alias("content"), F.max("content").alias("other"))
    same = F.when(F.col("content") == F.col("other"), F.col("content")).otherwise(F.raise_error(F.lit("two contents share their hashes")))
    classes, n = stages.cut_counted(one.select("h", "g", same.alias("content")).withColumn("c", F.monotonically_increasing_id()), "classes")
    members = hashed.select("rec", "h", "g").distinct()
    signed = classes.select("c", "content").mapInPandas(_band_batches(width, n_bands, rows_per_band), "c bigint, bands array<bigint>")
    banded = signed.select("c", F.explode("bands").alias("band"))
    # the join's own exchange is made once for both sides, and AQE can split a hot band in it
    x, y = banded.alias("x"), banded.alias("y")
    candidates = stages.cut(
        x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.c") < F.col("y.c"))).select(F.col("x.c").alias("xc"), F.col("y.c").alias("yc")).distinct(),
        "candidates",
        partitions=n * n_bands // BAND_ROWS,
    )
    left = classes.select(F.col("c").alias("xc"), F.col("h").alias("xh"), F.col("g").alias("xg"), F.col("content").alias("x"))
    right = classes.select(F.col("c").alias("yc"), F.col("h").alias("yh"), F.col("g").alias("yg"), F.col("content").alias("y"))
    compared = candidates.join(left, "xc").join(right, "yc").drop("xc", "yc").mapInPandas(_pair_batches(width, threshold), "xh bigint, xg int, yh bigint, yg int")
    pairs = stages.cut(compared, "pairs")
    stages.drop(candidates, classes)
    return pairs, members


def record_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(rec1, rec2)``, ``rec1 < rec2``: every pair of records with equal or similar content."""
    x = members.select(F.col("rec").alias("x"), F.col("h").alias("xh"), F.col("g").alias("xg"))
    y = members.select(F.col("rec").alias("y"), F.col("h").alias("yh"), F.col("g").alias("yg"))
    across = pairs.join(x, ["xh", "xg"]).join(y, ["yh", "yg"]).select("x", "y")
    within = x.join(y, (F.col("xh") == F.col("yh")) & (F.col("xg") == F.col("yg"))).where("x < y").select("x", "y")
    both = across.unionByName(within).where("x <> y")
    return both.select(F.least("x", "y").alias("rec1"), F.greatest("x", "y").alias("rec2")).distinct()


def linked_groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(rec, group_id)``: each record with the smallest record of its group, linked by similar classes.

    Classes are linked, not records: copies cost nothing.
    """
    x, y = F.concat_ws(":", "xh", "xg"), F.concat_ws(":", "yh", "yg")
    linked = connected_components(pairs.select(x.alias("a"), y.alias("b")), "a", "b").select(F.col("id").alias("cls"), F.col("group_id").alias("root"))
    rooted = members.select("rec", F.concat_ws(":", "h", "g").alias("cls")).join(linked, "cls", "left").select("rec", F.coalesce("root", "cls").alias("root"))
    names = rooted.groupBy("root").agg(F.min("rec").alias("group_id"))
    return rooted.join(names, "root").select("rec", "group_id")

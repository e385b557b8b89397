"""All-by-all and between-group comparison of aligned rows, in tiles.

Rows are dealt into blocks by a hash of their id; every pair of blocks is one tile, whose pairs are counted by
matrix products of one-hot rows inside one Arrow batch.  The number of blocks grows with the rows, so a
tile has a bounded size; a row is sent once for each block it meets, not once for each row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.plans.spread import spread

#: Rows of a block on average.
BLOCK = 256
#: Tiles of a task on average.
TILES = 16

COUNTS = "identical int, alike int, compared int, filled int"


def blocks_for(n: int, block: int = BLOCK) -> int:
    return max(1, -(-n // block))


def _one_hot(rows: list[str], alphabet: str) -> np.ndarray:
    codes = np.frombuffer("".join(rows).encode("latin-1", "replace"), dtype=np.uint8).reshape(len(rows), -1)
    table = np.full(256, len(alphabet), dtype=np.int64)
    table[np.frombuffer(alphabet.encode("latin-1"), dtype=np.uint8)] = np.arange(len(alphabet))
    return np.eye(len(alphabet) + 1, dtype=np.float32)[table[codes]]


def counted(alphabet: str, alike: np.ndarray) -> Callable:
    """A tile's score: identical, similar (identical ones included), compared and doubly filled columns."""

    def score(left: list[str], right: list[str]) -> dict[str, np.ndarray]:
        a, b = _one_hot(left, alphabet), _one_hot(right, alphabet)
        k = len(alphabet)
        flat = lambda x: x.reshape(len(x), -1)
        full_a, full_b = 1 - a[:, :, k], 1 - b[:, :, k]
        both = full_a @ full_b.T
        counts = {
            "identical": flat(a[:, :, :k]) @ flat(b[:, :, :k]).T,
            "alike": flat(a[:, :, :k] @ alike) @ flat(b[:, :, :k]).T,
            "compared": full_a.sum(1)[:, None] + full_b.sum(1)[None, :] - both,
            "filled": both,
        }
        return {n: np.rint(x).astype(np.int32) for n, x in counts.items()}

    return score


def _codes(rows: list[str], letters: str) -> np.ndarray:
    """``(rows, columns)`` places of residues among the letters; a gap is -1, any other residue the last place."""
    codes = np.frombuffer("".join(rows).encode("latin-1", "replace"), dtype=np.uint8).reshape(len(rows), -1)
    table = np.full(256, len(letters), dtype=np.int64)
    table[np.frombuffer(letters.encode("latin-1"), dtype=np.uint8)] = np.arange(len(letters))
    table[ord("-")] = -1
    return table[codes]


def _square(matrix: dict[tuple[str, str], int]) -> tuple[str, np.ndarray]:
    """The letters of a matrix, and its scores with a row and column of zeros for others and gaps."""
    letters = "".join(sorted({a for a, _ in matrix} - {"-"}))
    m = np.zeros((len(letters) + 1, len(letters) + 1))
    for (a, b), v in matrix.items():
        if a in letters and b in letters:
            m[letters.index(a), letters.index(b)] = v
    return letters, m


def affine(matrix: dict[tuple[str, str], int], gap_open: float = -5.0, gap_extend: float = 0.0) -> Callable:
    """A tile's score ``raw, self1, self2``: substitution scores with affine gaps; a gap extends where the column before has one, or is missing."""
    letters, m = _square(matrix)

    def score(left: list[str], right: list[str]) -> dict[str, np.ndarray]:
        a, b = _codes(left, letters), _codes(right, letters)
        own = lambda x: np.where(x >= 0, m[x, x], 0).sum(axis=1)
        raw = np.zeros((len(a), len(b)))
        before = np.ones(raw.shape, dtype=bool)
        for c in range(a.shape[1]):
            x, y = a[:, c], b[:, c]
            gapped = (x < 0)[:, None] | (y < 0)[None, :]
            raw += np.where(gapped, np.where(before, gap_extend, gap_open), m[x[:, None], y[None, :]])
            before = gapped
        return {"raw": raw, "self1": np.broadcast_to(own(a)[:, None], raw.shape), "self2": np.broadcast_to(own(b)[None, :], raw.shape)}

    return score


def substitution(matrix: dict[tuple[str, str], int], inner: dict[tuple[str, str], int] | None = None) -> Callable:
    """A tile's score ``total, matches, gaps, residues`` of rows ``seq`` or, with ``inner``, ``seq|topology``.

    The second matrix scores columns whose residues both lie in a membrane (``M``).
    """
    letters, m = _square(matrix)
    n = np.zeros_like(m)
    for (a, b), v in (inner or {}).items():
        if a in letters and b in letters:
            n[letters.index(a), letters.index(b)] = v

    def score(left: list[str], right: list[str]) -> dict[str, np.ndarray]:
        cut = lambda rows, k: [r.split("|")[k] for r in rows]
        a, b = _codes(cut(left, 0), letters), _codes(cut(right, 0), letters)
        full_a, full_b = (a >= 0).astype(np.float64), (b >= 0).astype(np.float64)
        matches = full_a @ full_b.T
        total = np.zeros(matches.shape)
        if inner is not None:
            s, t = _codes(cut(left, 1), "M") == 0, _codes(cut(right, 1), "M") == 0
        for c in range(a.shape[1]):
            x, y = a[:, c], b[:, c]
            value = m[x[:, None], y[None, :]]
            if inner is not None:
                value = np.where(s[:, c][:, None] & t[:, c][None, :], n[x[:, None], y[None, :]], value)
            total += np.where((x >= 0)[:, None] & (y >= 0)[None, :], value, 0)
        residues = full_a.sum(1)[:, None] + full_b.sum(1)[None, :]
        return {"total": total, "matches": matches.astype(np.int64), "gaps": (a.shape[1] - matches).astype(np.int64), "residues": residues.astype(np.int64)}

    return score


def profiles(left: list, right: list) -> dict[str, np.ndarray]:
    """A tile's score ``distance, matched, left_only, right_only, gaps`` of rows of numbers; NaN is a missing column.

    ``distance`` sums the absolute differences over the columns that both have.
    """
    a, b = (np.array([np.asarray(r, dtype=np.float64) for r in rows]) for rows in (left, right))
    here, there = ~np.isnan(a), ~np.isnan(b)
    distance = np.zeros((len(a), len(b)))
    for c in range(a.shape[1]):
        d = np.abs(a[:, c][:, None] - b[:, c][None, :])
        distance += np.where(np.isnan(d), 0, d)
    one, two = here.astype(np.float64), there.astype(np.float64)
    matched = one @ two.T
    return {"distance": distance, **{n: x.astype(np.int64) for n, x in (("matched", matched), ("left_only", one.sum(1)[:, None] - matched), ("right_only", two.sum(1)[None, :] - matched))}}


def products(left: list, right: list) -> dict[str, np.ndarray]:
    """A tile's score ``product`` of rows of numbers: their inner product."""
    return {"product": np.array([np.asarray(r, dtype=np.float64) for r in left]) @ np.array([np.asarray(r, dtype=np.float64) for r in right]).T}


def _tiles(score: Callable, ordered: bool, columns: str):
    names = ["id1", "id2", *[c.split()[0] for c in columns.split(",")]]

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        left, right = tile[tile["side"] == 0], tile[tile["side"] == 1]
        out = []
        for at in range(0, len(left), BLOCK):
            part = left.iloc[at : at + BLOCK]
            for to in range(0, len(right), BLOCK):
                other = right.iloc[to : to + BLOCK]
                x = np.repeat(part["id"].to_numpy(), len(other))
                y = np.tile(other["id"].to_numpy(), len(part))
                keep = (x < y) if ordered else np.ones(len(x), dtype=bool)
                if keep.any():
                    values = score(part["seq"].tolist(), other["seq"].tolist())
                    out.append(pd.DataFrame({"id1": x[keep], "id2": y[keep], **{n: c.ravel()[keep] for n, c in values.items()}}))
        return pd.concat(out) if out else pd.DataFrame({n: [] for n in names})

    return run


def alike_matrix(alphabet: str, matrix: dict[tuple[str, str], int] | None) -> np.ndarray:
    """Which residues count as similar: score 0 or more; without a matrix, equal ones."""
    n = len(alphabet)
    if matrix is None:
        return np.eye(n, dtype=np.float32)
    return np.array([[float(a == b or matrix.get((a, b), -1) >= 0) for b in alphabet] for a in alphabet], dtype=np.float32)


def pairs_within(rows: DataFrame, group: str, id_: str, seq: str, alphabet: str, matrix: dict | None = None, block: int = BLOCK) -> DataFrame:
    """As :func:`all_pairs`, of the rows of each group among themselves, with the group's column; only these tiles are made."""
    return scored_pairs(rows, id_, seq, counted(alphabet, alike_matrix(alphabet, matrix)), COUNTS, group, block)


def all_pairs(rows: DataFrame, id_: str, seq: str, alphabet: str, matrix: dict | None = None, block: int = BLOCK) -> DataFrame:
    """``(id1, id2, identical, alike, compared, filled)`` of every unordered pair of aligned rows, id1 < id2.

    Columns with a gap in both rows are not compared; one gap counts as a compared column without identity.
    Rows without id or sequence are left out; all sequences must have one length.
    """
    return scored_pairs(rows, id_, seq, counted(alphabet, alike_matrix(alphabet, matrix)), COUNTS, None, block)


def scored_pairs(rows: DataFrame, id_: str, content: str, score: Callable, columns: str, group: str | None = None, block: int = BLOCK) -> DataFrame:
    """``(id1, id2, <columns>)`` of every unordered pair of rows, id1 < id2, or of those of each group.

    ``score`` takes the contents of the rows of two blocks and gives a matrix for each column.  The pair (x, y)
    is made in the tile of both blocks, as left and right or as right and left: id1 < id2 decides.
    """
    base = rows.select(F.col(group).alias("g") if group else F.lit(0).alias("g"), F.col(id_).alias("id"), F.col(content).alias("seq")).where("g is not null and id is not null and seq is not null")
    sizes = base.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("k"))
    tiles = int(sizes.agg(F.sum(F.col("k").cast("long") * F.col("k"))).head()[0] or 1)
    own = base.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    numbers = F.sequence(F.lit(0), F.col("k") - 1)
    left = own.select("g", "id", "seq", F.lit(0).alias("side"), F.col("block").alias("bi"), F.explode(numbers).alias("bj"))
    right = own.select("g", "id", "seq", F.lit(1).alias("side"), F.explode(numbers).alias("bi"), F.col("block").alias("bj"))
    tile = _tiles(score, True, columns)
    kind, of = rows.schema[id_].dataType.simpleString(), rows.schema[group].dataType.simpleString() if group else "int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return tile(pdf).assign(g=pdf["g"].iloc[0])

    out = spread(left.unionByName(right), tiles, TILES, "g", "bi", "bj").groupBy("g", "bi", "bj").applyInPandas(run, f"id1 {kind}, id2 {kind}, {columns}, g {of}")
    return out.withColumnRenamed("g", group) if group else out.drop("g")


def pairs_between(left: DataFrame, right: DataFrame, id_: str, seq: str, alphabet: str, matrix: dict | None = None, block: int = BLOCK) -> DataFrame:
    """As :func:`all_pairs`, of every row of one table with every row of another."""
    return scored_between(left, right, id_, seq, counted(alphabet, alike_matrix(alphabet, matrix)), COUNTS, block)


def scored_between(left: DataFrame, right: DataFrame, id_: str, content: str, score: Callable, columns: str, block: int = BLOCK) -> DataFrame:
    """As :func:`scored_pairs`, of every row of one table with every row of another."""
    a = left.select(F.col(id_).alias("id"), F.col(content).alias("seq")).where("id is not null and seq is not null")
    b = right.select(F.col(id_).alias("id"), F.col(content).alias("seq")).where("id is not null and seq is not null")
    na, nb = blocks_for(a.count(), block), blocks_for(b.count(), block)
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    x = a.select("id", "seq", F.lit(0).alias("side"), own(na).alias("bi"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("bj"))
    y = b.select("id", "seq", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(na - 1))).alias("bi"), own(nb).alias("bj"))
    kind = left.schema[id_].dataType.simpleString()
    return spread(x.unionByName(y), na * nb, TILES, "bi", "bj").groupBy("bi", "bj").applyInPandas(_tiles(score, False, columns), f"id1 {kind}, id2 {kind}, {columns}")


def id_pairs(left: DataFrame, right: DataFrame, id_: str, block: int = BLOCK) -> DataFrame:
    """``(id1, id2)`` of every row of one table with every row of another, by a join on pairs of blocks."""
    na, nb = blocks_for(left.count(), block), blocks_for(right.count(), block)
    own = lambda n: F.pmod(F.xxhash64(id_), F.lit(n)).cast("int")
    a = left.select(F.col(id_).alias("id1"), own(na).alias("bi"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("bj"))
    b = right.select(F.col(id_).alias("id2"), F.explode(F.sequence(F.lit(0), F.lit(na - 1))).alias("bi"), own(nb).alias("bj"))
    return a.join(b.hint("shuffle_hash"), ["bi", "bj"]).select("id1", "id2")


def incremental_pairs(old: DataFrame, new: DataFrame, id_: str) -> DataFrame:
    """The pairs that an update adds: new with new (id1 < id2), and new with old."""
    across = id_pairs(new, old, id_).select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"))
    return id_pairs(new, new, id_).where("id1 < id2").unionByName(across)


def canonical(df: DataFrame, a: str, b: str) -> DataFrame:
    """A pair's two ids in order; whatever order they came in means the same pair."""
    return df.withColumns({a: F.least(a, b), b: F.greatest(a, b)})

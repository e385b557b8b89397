"""Sequence ids and the ways they may be written.

A plain id is ``<taxon>-<gene>``.  Tables that come from outside may surround it with blanks, put ``@``
in place of the first ``-``, or give its hash from an id dictionary instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def stripped(c: Column) -> Column:
    """The id without blanks around it; null where nothing is left."""
    t = F.trim(c)
    return F.when(t != "", t)


def is_coded(c: Column) -> Column:
    """True for a stripped id that must be a hash: it has neither ``-`` nor ``@``."""
    return c.isNotNull() & (F.instr(c, "-") == 0) & (F.instr(c, "@") == 0)


def dashed(c: Column) -> Column:
    """A stripped id with ``-`` after the taxon, where ``@`` stood there."""
    at, dash = F.instr(c, "@"), F.instr(c, "-")
    return F.when((at > 0) & ((dash == 0) | (at < dash)), F.regexp_replace(c, "^([^@]*)@", "$1-")).otherwise(c)


def taxon(c: Column, separator: str = "-") -> Column:
    """The text before the first separator."""
    return F.substring_index(c, separator, 1)


def names_by_hash(id_map: DataFrame) -> DataFrame:
    """``(code, plain)``, one row per hash; of several names the smallest."""
    return (
        id_map.select(stripped(F.col("hash")).alias("code"), stripped(F.col("name")).alias("plain"))
        .where("code is not null and plain is not null")
        .groupBy("code")
        .agg(F.min("plain").alias("plain"))
    )


def plain_pairs(pairs: DataFrame, id_map: DataFrame, left: str, right: str, *keep: str) -> DataFrame:
    """``(a, b, *keep)`` with both ids plain and present; rows that miss an id are left out.

    Most rows carry no hash, and those never meet a shuffle: only rows with a hash on a side are joined
    with the dictionary, whose size is not bounded.  In that join a side without a hash gets a key made
    of both ids, which matches nothing and spreads over all partitions.  A hash that the dictionary
    lacks stays as it is.
    """
    # inline() keeps the cleaning from being pushed into every later filter
    base = pairs.select(
        F.inline(F.array(F.struct(stripped(F.col(left)).alias("a"), stripped(F.col(right)).alias("b"), *[F.col(k) for k in keep])))
    ).where("a is not null and b is not null")
    ca, cb = is_coded(F.col("a")), is_coded(F.col("b"))
    clear = base.where(~ca & ~cb).select(
        F.inline(F.array(F.struct(dashed(F.col("a")).alias("a"), dashed(F.col("b")).alias("b"), *[F.col(k) for k in keep])))
    )
    names = names_by_hash(id_map)
    loose = F.concat_ws("-", F.col("a"), F.col("b"))
    coded = base.where(ca | cb)
    for side, own in (("a", ca), ("b", cb)):
        key = f"key_{side}"
        coded = (
            coded.withColumn(key, F.when(own, F.col(side)).otherwise(loose))
            .join(names.select(F.col("code").alias(key), F.col("plain").alias(f"plain_{side}")), key, "left")
        )
    coded = coded.select(
        F.coalesce("plain_a", dashed(F.col("a"))).alias("a"), F.coalesce("plain_b", dashed(F.col("b"))).alias("b"), *keep
    )
    return clear.unionByName(coded)


def plain_members(members: DataFrame, id_map: DataFrame, member: str, *keep: str) -> DataFrame:
    """``(member, *keep)`` with plain ids; missing members are left out.  Joins only rows with a hash."""
    base = members.select(stripped(F.col(member)).alias("member"), *keep).where("member is not null")
    coded = is_coded(F.col("member"))
    clear = base.where(~coded).withColumn("member", dashed(F.col("member")))
    named = (
        base.where(coded)
        .join(names_by_hash(id_map), F.col("member") == F.col("code"), "left")
        .select(F.coalesce("plain", "member").alias("member"), *keep)
    )
    return clear.unionByName(named)


def short_codes(ids: DataFrame, name: str, size: int = 10) -> DataFrame:
    """``(hash, name)``: a short code for every id, the same in every run; a code that two ids share is an error.

    Choose ``size`` (hex digits, up to 32) so that this does not come about.
    """
    coded = ids.select(F.col(name).alias("name")).where("name is not null").distinct()
    per = coded.groupBy(F.substr(F.md5("name"), F.lit(1), F.lit(size)).alias("hash")).agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n"))
    shared = F.raise_error(F.concat(F.lit("two ids share the code "), F.col("hash")))
    return per.select(F.when(F.col("n") == 1, F.col("hash")).otherwise(shared).alias("hash"), "name")

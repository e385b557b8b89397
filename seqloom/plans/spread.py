"""Partitions for work that is heavy though its data are small."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, groups: int, per_task: int, *keys: str) -> DataFrame:
    """``df`` by the hash of its group keys, about ``per_task`` groups a task, and no fewer tasks than the session's partitions.

    Adaptive execution sizes partitions by bytes and would give many small but costly groups to one task; a
    stated number of partitions is left as it is.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, min(groups, usual), -(-groups // per_task)), *keys)

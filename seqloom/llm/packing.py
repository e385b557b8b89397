"""Filling fixed-capacity containers with items: Karmarkar-Karp multiway differencing.

Items longer than the capacity are cut into full containers and a rest.  All other items are dealt into
shards of bounded size by a hash, and every shard is packed on its own: starting from the least number of
windows that can hold it, the items are partitioned into near-equal windows by differencing, and the
number of windows rises while one of them exceeds the capacity.

Differencing keeps a heap of partial partitions, the one of the largest spread first.  The two largest
are merged so that their imbalances oppose each other: the fullest window of one with the emptiest of the
other.  A partial partition stores only its windows above its emptiest one.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.plans.spread import spread
from seqloom.plans.stages import Stages

#: Items a shard holds on average; a shard is one task's work, so this bounds the task.
SHARD_ITEMS = 1500
#: Shards of a task on average.
SHARDS_A_TASK = 32


def difference(sizes: Sequence[int], k: int) -> list[list[int]]:
    """The positions of the items in each of ``k`` near-equal windows."""
    if k == 1:
        return [list(range(len(sizes)))]
    # a partial partition: (-spread, number, loads in descending order without trailing zeros, windows)
    heap = [(-s, i, [s], [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        _, _, a, wa = heapq.heappop(heap)
        _, _, b, wb = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over > 0:  # windows of both must be joined: the emptiest of a with the fullest of b and on
            # a's last `over` windows, fullest first, meet b's last ones, emptiest first
            ja, jb = a[len(a) - over :], b[len(b) - over :]
            joined = [x + y for x, y in zip(ja, reversed(jb))]
            windows = [x + y for x, y in zip(wa[len(a) - over :], reversed(wb[len(b) - over :]))]
            loads = a[: len(a) - over] + b[: len(b) - over] + joined
            windows = wa[: len(a) - over] + wb[: len(b) - over] + windows
        else:
            loads, windows = a + b, wa + wb
        order = sorted(range(len(loads)), key=loads.__getitem__, reverse=True)
        loads, windows = [loads[i] for i in order], [windows[i] for i in order]
        base = loads[-1] if len(loads) == k else 0
        if base:
            loads = [x - base for x in loads]
        # the emptiest windows keep their items but lie at level zero; they stay in the list
        heapq.heappush(heap, (-loads[0], number, loads, windows))
        number += 1
    windows = heap[0][3] if heap else []
    return windows + [[] for _ in range(k - len(windows))]


#: Two windows are divided anew when they hold at most this many items together.
JOINT_ITEMS = 14


def _division(sizes: np.ndarray, most: int, least: int) -> np.ndarray | None:
    """Which items make up the fullest window from ``least`` to ``most``; None: no such."""
    sums = np.zeros(1, dtype=np.int64)
    for s in sizes:
        sums = np.concatenate([sums, sums + s])
    good = np.where((sums <= most) & (sums >= least), sums, -1)
    best = int(good.argmax())
    return None if good[best] < 0 else (best >> np.arange(len(sizes))) & 1 == 1


def relieve(sizes: np.ndarray, windows: list[list[int]], capacity: int, tries: int = 24) -> bool:
    """Divide pairs of windows anew until none exceeds the capacity; false if that does not come about.

    The fullest window is taken together with the emptiest ones, in turn, until all their items fit in
    two windows; one is filled as far as it goes, so their slack stays in one piece.  Where no division
    fits, as with windows of few items, the excess is handed on to a window of more items, once for
    every eighth window.
    """
    loads = np.array([int(sizes[w].sum()) for w in windows], dtype=np.int64)
    handed = 0

    def divide(w: int, u: int, spare: int) -> bool:
        joint = windows[w] + windows[u]
        total = int(loads[w] + loads[u])
        if u == w or len(joint) > JOINT_ITEMS:
            return False
        one = _division(sizes[joint], capacity, total - capacity - spare)
        if one is None:
            return False
        windows[w] = [i for i, x in zip(joint, one) if x]
        windows[u] = [i for i, x in zip(joint, one) if not x]
        loads[w], loads[u] = sizes[windows[w]].sum(), sizes[windows[u]].sum()
        return True

    while True:
        w = int(loads.argmax())
        over = int(loads[w]) - capacity
        if over <= 0:
            return True
        room = np.argsort(loads, kind="stable")[:tries]
        if any(divide(w, int(u), 0) for u in room[loads[room] + over <= capacity]):
            continue
        many = np.array([len(x) for x in windows])
        next_to = np.argsort(-many + loads / (2.0 * capacity), kind="stable")
        next_to = next_to[(loads[next_to] <= capacity) & (many[next_to] > 3)][handed % 7 : handed % 7 + tries]
        handed += 1
        if 8 * handed > len(windows) + 64 or not any(divide(w, int(u), over) for u in next_to):
            return False


def pack(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Windows of item positions, none above the capacity; every size lies in 1..capacity.

    Windows that differencing leaves slightly too full are first relieved in pairs; the number of
    windows rises when that fails.
    """
    if not len(sizes):
        return []
    array = np.asarray(sizes, dtype=np.int64)
    k = -(-int(array.sum()) // capacity)
    while True:
        windows = difference(sizes, k)
        if relieve(array, windows, capacity):
            return [w for w in windows if w]
        k += 1


def _shard(capacity: int):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["rest", "row"], ascending=[False, True], ignore_index=True)
        windows = pack(items["rest"].tolist(), capacity)
        container = np.empty(len(items), dtype=np.int64)
        place = np.empty(len(items), dtype=np.int32)
        for w, window in enumerate(windows):
            at = 0
            for i in window:
                container[i], place[i] = w, at
                at += int(items["rest"][i])
        return items.assign(container=container, place=place)

    return run


def fill_containers(items: DataFrame, key: str, size: str, capacity: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``(key, piece, container, place, length)``: where each piece of an item lies.

    * An item up to the capacity is one piece; a longer one gives full pieces, each alone in a container,
      and a rest.  ``piece`` counts from 0, ``place`` is the offset in the container.
    * An item of size 0 or null takes no room: one row of length 0 without container and place.  A
      negative size is an error.  Repeated and null keys are items of their own.
    * ``container`` names the shard and window, or the row and piece of a full one.  Other columns are
      ignored, whatever their names.  Empty in, empty out.
    """
    stages = Stages(items.sparkSession, "packing")
    rows = items.select(F.col(key).alias("key"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))
    rows, n = stages.cut_counted(rows, "sizes")
    checked = F.when(F.col("size") >= 0, F.col("size")).otherwise(F.raise_error(F.lit("negative size")))
    # the stage table's row places are fixed, so this id is the same in every run of a task
    rows = rows.select("key", checked.alias("size"), F.monotonically_increasing_id().alias("row"))
    full, rest = F.floor(F.col("size") / F.lit(capacity)).cast("int"), (F.col("size") % F.lit(capacity)).cast("long")
    shards = max(1, -(-n // shard_items))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards))
    cut = rows.select("key", "row", full.alias("full"), rest.alias("rest"), shard.alias("shard"))
    kind = items.schema[key].dataType.simpleString()
    packed = (
        spread(cut.where("rest > 0"), shards, SHARDS_A_TASK, "shard")
        .groupBy("shard")
        .applyInPandas(_shard(capacity), f"key {kind}, row bigint, full int, rest bigint, shard bigint, container bigint, place int")
    )
    window = F.concat_ws(".", F.lit("shard"), "shard", "container")
    rests = packed.select("key", F.col("full").alias("piece"), window.alias("container"), "place", F.col("rest").cast("int").alias("length"))
    pieces = cut.where("full > 0").select("key", "row", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"))
    alone = F.concat_ws(".", F.lit("row"), "row", "piece")
    fulls = pieces.select("key", "piece", alone.alias("container"), F.lit(0).alias("place"), F.lit(capacity).alias("length"))
    none = cut.where("full = 0 and rest = 0").select("key", F.lit(0).alias("piece"), F.lit(None).cast("string").alias("container"), F.lit(None).cast("int").alias("place"), F.lit(0).alias("length"))
    return rests.unionByName(fulls).unionByName(none)


def packing_invariants(pieces: DataFrame, key: str, capacity: int) -> DataFrame:
    """One row: how many keys there are, containers above the capacity, containers whose pieces overlap or leave a gap,
    and keys of several pieces of which one but the last is not full."""
    held = pieces.where("container is not null")
    ends = held.groupBy("container").agg(F.sum("length").alias("sum"), F.max(F.col("place") + F.col("length")).alias("end"), F.count_distinct("place").alias("places"), F.count(F.lit(1)).alias("n"))
    last = pieces.groupBy(key).agg(F.max("piece").alias("last"), F.count(F.when(F.col("length") < capacity, 1)).alias("part"), F.count(F.lit(1)).alias("n"))
    a = ends.agg(F.count(F.when(F.col("sum") > capacity, 1)).alias("too_full"), F.count(F.when((F.col("sum") != F.col("end")) | (F.col("places") != F.col("n")), 1)).alias("overlaps"))
    b = last.agg(F.count(F.lit(1)).alias("keys"), F.count(F.when((F.col("part") > 1) | (F.col("last") + 1 != F.col("n")), 1)).alias("wrong"))
    return b.crossJoin(a).select("keys", "too_full", "overlaps", "wrong")

"""Seeded random operators: shuffles, null distributions, simulated evolution, coupled Markov chains."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.residues import fitness


def region_shuffle(columns: DataFrame, region: str, shuffles: int, seed: int) -> DataFrame:
    """``(shuffle, id, pos, aa)``: residues permuted among the positions of their own region, ``shuffles`` times.

    ``columns`` is ``(id, pos, aa, <region>)``.  The order of a permutation is a hash of (seed, shuffle, id,
    pos), so it does not depend on how rows are spread.
    """
    x = columns.select("id", "pos", "aa", F.col(region).alias("region"), F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))).alias("shuffle"))
    group = Window.partitionBy("shuffle", "id", "region")
    places = x.select("shuffle", "id", "region", "pos", F.row_number().over(group.orderBy("pos")).alias("k"))
    order = F.xxhash64(F.lit(seed), "shuffle", "id", "pos")
    drawn = x.select("shuffle", "id", "region", "aa", F.row_number().over(group.orderBy(order, "pos")).alias("k"))
    return places.join(drawn, ["shuffle", "id", "region", "k"]).select("shuffle", "id", "pos", "aa")


def shuffled_rows(profile: DataFrame, key: str, pos: str, seed: int) -> DataFrame:
    """Whole rows of a profile in a random order, renumbered."""
    order = F.xxhash64(F.lit(seed), key, pos)
    new = F.row_number().over(Window.partitionBy(key).orderBy(order, pos)) - 1
    return profile.withColumn("__new", new).drop(pos).withColumnRenamed("__new", pos)


def null_distribution(pairs: DataFrame, columns: DataFrame, region: str, shuffles: int, seed: int, score: Callable[[DataFrame], DataFrame], value: str) -> DataFrame:
    """``(id1, id2, observed, shuffled)``: each pair's score, and those of its rows after ``shuffles`` shuffles.

    ``score`` takes aligned columns ``(id1, id2, pos, aa1, aa2)`` and gives ``(id1, id2, <value>)``; a
    shuffle is a part of the ids, so all of them are scored in one plan.
    """
    from seqloom.operators.alignment import aligned_columns

    observed = score(aligned_columns(columns.select("id", "pos", "aa"), pairs)).select("id1", "id2", F.col(value).alias("observed"))
    mixed = region_shuffle(columns, region, shuffles, seed).select(F.struct("shuffle", "id").alias("id"), "pos", "aa")
    numbered = pairs.select("id1", "id2", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))).alias("shuffle"))
    keyed = numbered.select(F.struct("shuffle", F.col("id1").alias("id")).alias("id1"), F.struct("shuffle", F.col("id2").alias("id")).alias("id2"))
    scored = score(aligned_columns(mixed, keyed)).select(F.col("id1.id").alias("id1"), F.col("id2.id").alias("id2"), F.col("id1.shuffle").alias("shuffle"), F.col(value).alias("s"))
    null = scored.groupBy("id1", "id2").agg(F.transform(F.array_sort(F.collect_list(F.struct("shuffle", "s"))), lambda x: x["s"]).alias("shuffled"))
    return observed.join(null, ["id1", "id2"])


def null_distributions(columns: DataFrame, region: str, shuffles: int, seed: int, score: Callable, schema: str, value: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(id1, id2, observed, shuffled)`` of all pairs of rows of one length, scored in tiles (:func:`~seqloom.operators.pairs.scored_pairs`).

    ``score`` and ``schema`` are those of a tile; ``value`` adds a column ``value``.  Shuffle -1 is the rows as they are.
    """
    from seqloom.operators.pairs import scored_pairs

    mixed = region_shuffle(columns, region, shuffles, seed)
    every = mixed.unionByName(columns.select(F.lit(-1).alias("shuffle"), "id", "pos", "aa"))
    rows = every.groupBy("shuffle", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "aa"))), lambda x: x["aa"]), "").alias("seq"))
    scored = value(scored_pairs(rows, "id", "seq", score, schema, "shuffle")).select("id1", "id2", "shuffle", "value")
    null = F.transform(F.array_sort(F.collect_list(F.when(F.col("shuffle") >= 0, F.struct("shuffle", "value")))), lambda x: x["value"])
    return scored.groupBy("id1", "id2").agg(F.max(F.when(F.col("shuffle") < 0, F.col("value"))).alias("observed"), null.alias("shuffled"))


def mutated(parents: DataFrame, generation: int, seed: int, substitution: dict[str, tuple[str, list[float]]], indel_rate: float = 0.001, letters: str = "ARNDCQEGHILKMFPSTWYV") -> DataFrame:
    """``(id, parent, seq, positions)``: children of ``(id, parent, seq, positions)`` with substitutions and heavy-tailed indels.

    ``substitution`` gives for a residue the letters and their cumulative probabilities.  A child's
    randomness comes from (seed, generation, id) only.  ``positions`` tells homologous positions as
    ``(child, n)``: the child that first had it, and its number there.
    """

    def run(batches: Iterable[pd.DataFrame]):
        for batch in batches:
            seqs, places = [], []
            for child, seq, positions in zip(batch["id"], batch["seq"], batch["positions"]):
                rng = random.Random(f"{seed}/{generation}/{child}")
                out, kept, skip, fresh = [], [], 0, 0
                for aa, p in zip(seq, positions):
                    if skip:
                        skip -= 1
                        continue
                    if rng.random() < indel_rate:
                        size = max(1, int(rng.paretovariate(1.5)))
                        if rng.random() < 0.5:
                            skip = min(size, len(seq)) - 1
                            continue
                        out.extend(rng.choice(letters) for _ in range(size))
                        for _ in range(size):
                            fresh += 1
                            kept.append({"child": int(child), "n": fresh})
                    u = rng.random()
                    order, cumulative = substitution.get(aa, (aa, [1.0]))
                    out.append(next((o for o, c in zip(order, cumulative) if u < c), aa))
                    kept.append({"child": p["child"], "n": p["n"]})
                seqs.append("".join(out))
                places.append(kept)
            yield batch[["id", "parent"]].assign(seq=seqs, positions=places)

    kind = parents.schema["id"].dataType.simpleString()
    return parents.select("id", "parent", "seq", "positions").mapInPandas(run, f"id {kind}, parent {kind}, seq string, positions {POSITIONS}")


def next_generation(population: DataFrame, size: int, generation: int, seed: int, substitution: dict, unchanged: float = 0.1) -> DataFrame:
    """``(id, parent, seq, positions)``: ``size`` children, parents drawn in proportion to fitness; a share is copied unchanged."""
    from seqloom.operators.statistics import cumulative, picked

    weighed = cumulative(population.withColumn("fitness", fitness(F.col("seq"))).select("id", "fitness"), "fitness", "id")
    spark = population.sparkSession
    children = spark.range(size).select((F.col("id") + F.lit(generation * 10**9)).alias("child"))
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit(generation), "child"), F.lit(2**52)) / F.lit(float(2**52))
    drawn = picked(weighed.select("id", "share", "cumulative"), children.select("child", u.alias("u")), "id")
    born = drawn.select("child", F.col("id").alias("p")).join(population.select(F.col("id").alias("p"), "seq", "positions"), "p")
    born = born.select(F.col("child").alias("id"), F.col("p").alias("parent"), "seq", "positions")
    copied = F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(generation), "id"), F.lit(1000)) < F.lit(int(unchanged * 1000))
    return born.where(copied).unionByName(mutated(born.where(~copied), generation, seed, substitution))


def simulate(ancestor: str, size: int, generations: int, seed: int, substitution: dict, spark) -> DataFrame:
    """All generations ``(generation, id, parent, seq, positions)`` of a simulated population; each is written before the next."""
    from seqloom.plans.stages import Stages

    stages = Stages(spark, "generations")
    first = spark.createDataFrame([(0, None, ancestor, [(0, n) for n in range(len(ancestor))])], f"id bigint, parent bigint, seq string, positions {POSITIONS}")
    population, out = first, first.withColumn("generation", F.lit(0))
    for g in range(1, generations + 1):
        population = stages.cut(next_generation(population, size, g, seed, substitution), "generation")
        out = out.unionByName(population.withColumn("generation", F.lit(g)))
    return out


def sampled(records: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """``n`` records without replacement, the ones of smallest seeded hash: the same ones however rows are spread."""
    order = F.xxhash64(F.lit(seed), *key)
    return records.orderBy(order, *key).limit(n)


#: Homologous positions: the record that first had one, and its number there.
POSITIONS = "array<struct<child: bigint, n: bigint>>"


@dataclass
class Variable:
    """A bounded variable of a chain; proposals are Gaussian, folded back into the bounds."""

    name: str
    low: float
    high: float
    spread: float = 0.05

    def draw(self, rng: random.Random) -> float:
        return rng.uniform(self.low, self.high)

    def propose(self, now: float, rng: random.Random) -> float:
        return fold(rng.gauss(now, (self.high - self.low) * self.spread), self.low, self.high)


def fold(x: float, low: float, high: float) -> float:
    """A value reflected at the bounds as often as needed."""
    width = high - low
    if width <= 0:
        return low
    away = (x - low) % (2 * width)
    return low + min(away, 2 * width - away)


@dataclass
class _Chain:
    values: dict[str, float]
    score: float
    heat: float
    history: list[float] = field(default_factory=list)


def coupled_chains(
    variables: list[Variable], batch_score: Callable[[list[dict[str, float]]], list[float]], steps: int = 1000, chains: int = 3, seed: int = 1, cold: float = 0.1, hot: float = 0.32, burn_in: int = 100, memory: int = 1000, sample_every: int = 1
) -> tuple[pd.DataFrame, dict[str, float], float]:
    """Metropolis-coupled chains: (trace of the cold chain, the best values, their score).

    All chains' proposals of a generation are scored in one call of ``batch_score``, which may run them as
    one DataFrame.  A proposal that is no better is taken with a Gaussian probability of how far it lies
    below the chain's score, in units of the range of the scores seen times the heat.  After each generation two chains are
    drawn and may swap.  The trace has ``gen``, the variables and ``result``, from the burn-in on.
    """
    rng = random.Random(seed)
    starts: list[dict[str, float]] = []
    scores: list[float] = []
    first = [{v.name: v.draw(rng) for v in variables} for _ in range(30)]
    found = batch_score(first)
    for values, s in zip(first, found):
        starts.append(values)
        scores.append(s)
        if len(starts) >= chains and len(set(scores)) >= 2:
            break
    if len(set(scores)) < 2:
        raise ValueError("thirty random draws gave a single score")
    state = [_Chain(dict(starts[i]), scores[i], cold if i == 0 else hot) for i in range(chains)]
    seen = list(scores)
    best = max(range(len(scores)), key=scores.__getitem__)
    best_values, best_score = dict(starts[best]), scores[best]
    trace = []
    for gen in range(steps + 1):
        proposals = [{v.name: v.propose(c.values[v.name], rng) for v in variables} for c in state]
        for c, values, s in zip(state, proposals, batch_score(proposals)):
            seen.append(s)
            spread = max(seen[-memory:]) - min(seen[-memory:]) or 1.0
            if s >= c.score or rng.random() < math.exp(-(((c.score - s) / (spread * c.heat)) ** 2) / 2):
                c.values, c.score = values, s
            if s > best_score:
                best_values, best_score = dict(values), s
        if chains > 1:
            i, j = rng.sample(range(chains), 2)
            a, b = state[i], state[j]
            spread = max(seen[-memory:]) - min(seen[-memory:]) or 1.0
            gain = (b.score - a.score) * (1 / a.heat - 1 / b.heat) / spread
            if gain >= 0 or rng.random() < math.exp(gain):
                a.values, b.values, a.score, b.score = b.values, a.values, b.score, a.score
        if gen >= burn_in and gen % sample_every == 0:
            coldest = min(state, key=lambda c: c.heat)
            trace.append({"gen": gen, **coldest.values, "result": coldest.score})
    return pd.DataFrame(trace, columns=["gen", *[v.name for v in variables], "result"]), best_values, best_score


def pointwise(objective: Callable, names: list[str], *params) -> Callable[[list[dict[str, float]]], list[float]]:
    """A batch score for :func:`coupled_chains` of a plain function ``f(values)`` or ``f(values, params)``; values come in the order of names."""

    def batch(proposals: list[dict[str, float]]) -> list[float]:
        return [float(objective([p[n] for n in names], *([list(params)] if params else []))) for p in proposals]

    return batch


def parameter_grid(spark, **ranges: tuple[float, float, int]) -> DataFrame:
    """All combinations of evenly spaced parameters, given as (low, high, number)."""
    out = None
    for name, (low, high, n) in ranges.items():
        one = spark.range(n).select((F.lit(low) + F.col("id") * F.lit((high - low) / max(1, n - 1))).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out



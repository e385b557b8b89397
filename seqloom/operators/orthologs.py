"""The ortholog caller: groups are divided by Markov clustering under settings that coupled chains search for.

A group of up to ``most`` members is one task's work: its chains propose inflation and threshold, each proposal
is a Markov clustering of the group, scored with its cliques, and the best clustering is taken if it beats the
group's own score; its parts are divided in the same way until none improves.  Larger groups are first divided
by the distributed search over a list of settings (:func:`~seqloom.operators.grouping.subdivided`); one that no
setting divides is final.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.grouping import Setting, subdivided
from seqloom.operators.stochastic import Variable, coupled_chains
from seqloom.plans.spread import spread
from seqloom.plans.stages import Stages

#: Settings by which groups are divided that are too large for one task.
SETTINGS = [Setting(i, t) for i in (1.5, 2.0, 4.0) for t in (0.3, 0.6, 0.8)]
#: Members of a group that one task divides.
MOST_MEMBERS = 400


def orthogroups(edges: DataFrame, members: DataFrame, steps: int = 100, seed: int = 1, separator: str = "-", most: int = MOST_MEMBERS, settings: list[Setting] | None = None) -> DataFrame:
    """``(grp, clique, member)``: final groups and, where a member belongs to a clique of its group, that clique.

    ``members`` ``(grp, member)`` are the groups to begin with.  Names extend the parent's, ``group_0_1``; cliques
    are ``group_0_1_c1``.  A member without an edge in its group stands alone.  Empty in, empty out.
    """
    stages = Stages(edges.sparkSession, "orthologs")
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    large = members.join(sizes.where(F.col("n") > most).select("grp"), "grp", "left_semi")
    first = members.join(sizes.where(F.col("n") <= most).select("grp"), "grp", "left_semi").select("grp", "member")
    if large.head(1):
        first = first.unionByName(subdivided(edges, large, settings or SETTINGS, most + 1, separator))
    first = stages.cut(first, "first")
    n = first.select("grp").distinct().count()
    inner = first.select(F.col("member").alias("seq1"), F.col("grp").alias("g1"))
    other = first.select(F.col("member").alias("seq2"), F.col("grp").alias("g2"))
    rows = edges.join(inner, "seq1").join(other, "seq2").where("g1 = g2").select(F.col("g1").alias("grp"), "seq1", "seq2", "score")
    every = first.select("grp", F.col("member").alias("seq1"), F.lit(None).cast("string").alias("seq2"), F.lit(0.0).alias("score"))

    def divide(pdf: pd.DataFrame) -> pd.DataFrame:
        named = _divided(pdf, steps, seed, separator, most)
        return pd.DataFrame(named, columns=["grp", "clique", "member"])

    return spread(rows.unionByName(every), n, 8, "grp").groupBy("grp").applyInPandas(divide, "grp string, clique string, member string")


def _divided(pdf: pd.DataFrame, steps: int, seed: int, separator: str, most: int) -> list[tuple[str, str | None, str]]:
    ids = sorted(pdf["seq1"][pdf["seq2"].isna()])
    at = {m: i for i, m in enumerate(ids)}
    e = pdf[pdf["seq2"].notna()]
    weights = {(at[a], at[b]) if at[a] < at[b] else (at[b], at[a]): s for a, b, s in zip(e["seq1"], e["seq2"], e["score"])}
    taxa = [m.split(separator, 1)[0] for m in ids]
    out, todo = [], [(pdf["grp"].iloc[0], list(range(len(ids))))]
    while todo:
        name, group = todo.pop()
        g = _Group(group, weights, taxa)
        parts = g.divided(steps, f"{seed}/{name}") if 2 < len(group) <= most and g.edges else None
        if parts:
            todo += [(f"{name}_{k}", part) for k, part in enumerate(parts)]
            continue
        clique = {v: f"{name}_c{k + 1}" for k, c in enumerate(g.cliques()) for v in c} if len(group) <= most else {}
        out += [(name, clique.get(v), ids[v]) for v in group]
    return out


class _Group:
    """A group, its edges among themselves, and the taxa of its members."""

    def __init__(self, group: list[int], weights: dict[tuple[int, int], float], taxa: list[str]):
        inside = set(group)
        self.group, self.taxa = group, taxa
        self.edges = {k: s for k, s in weights.items() if k[0] in inside and k[1] in inside}

    def divided(self, steps: int, seed: str) -> list[list[int]] | None:
        """The best clustering that the chains meet, larger parts first; None where it does not beat the group itself."""
        scores = list(self.edges.values())
        best: tuple[float, list[list[int]]] | None = None
        known: dict[tuple, float] = {}

        def batch(proposals: list[dict[str, float]]) -> list[float]:
            nonlocal best
            found = []
            for p in proposals:
                parts = self.clusters(p["inflation"], p["threshold"])
                digest = tuple(map(tuple, parts))
                if digest not in known:
                    known[digest] = sum(_Group(part, self.edges, self.taxa).score() for part in parts)
                if len(parts) > 1 and (best is None or known[digest] > best[0]):
                    best = (known[digest], parts)
                found.append(known[digest])
            return found

        variables = [Variable("inflation", 1.1, 20.0), Variable("threshold", min(scores), max(scores))]
        try:
            coupled_chains(variables, batch, steps, seed=seed, burn_in=0)
        except ValueError:  # all draws score alike: nothing to search for
            return None
        return best[1] if best is not None and best[0] > self.score() + 1e-9 else None

    def clusters(self, inflation: float, threshold: float, prune: float = 1e-5, rounds: int = 200) -> list[list[int]]:
        """Markov clustering, in full matrices; larger clusters first, each in order."""
        n = len(self.group)
        at = {v: i for i, v in enumerate(self.group)}
        m = np.zeros((n, n))
        for (a, b), s in self.edges.items():
            if s >= threshold:
                m[at[a], at[b]] = m[at[b], at[a]] = s
        m[np.arange(n), np.arange(n)] = np.where(m.max(axis=0) > 0, m.max(axis=0), 1.0)
        m /= m.sum(axis=0)
        for _ in range(rounds):
            new = (m @ m) ** inflation
            new /= new.sum(axis=0)
            new[new < prune] = 0
            new /= new.sum(axis=0)
            still = np.abs(new - m).max()
            m = new
            if still < 1e-4:
                break
        else:
            raise RuntimeError("Markov clustering of a group has not settled")
        return _components(self.group, [(self.group[i], self.group[j]) for i, j in zip(*np.nonzero(m)) if i != j])

    def score(self) -> float:
        """The product score of the members outside cliques, and of every clique; counts are those of the whole group."""
        if len(self.group) == 1:
            return 0.0
        n = Counter(self.taxa[v] for v in self.group)
        cliques = self.cliques()
        taken = {v for c in cliques for v in c}
        return sum(self._product(part, n) for part in [[v for v in self.group if v not in taken], *cliques] if part)

    def _product(self, part: list[int], n: Counter) -> float:
        if len(part) == 1:
            return 0.0
        single, multiple = 1.0, 1.0
        for taxon, k in Counter(self.taxa[v] for v in part).items():
            if k == 1:
                single *= 2 * (1 + n[taxon] / len(self.group))
            else:
                multiple *= k * (k / n[taxon])
        return single - multiple

    def cliques(self, below: float = 0.05) -> list[list[int]]:
        """Groups of best hits, of three members at least and not the whole, whose inner scores the others hardly reach into."""
        best: dict[int, float] = defaultdict(lambda: -math.inf)
        for (a, b), s in self.edges.items():
            best[a], best[b] = max(best[a], s), max(best[b], s)
        hits = [(a, b) for (a, b), s in self.edges.items() if s in (best[a], best[b])]
        out = []
        for c in _components(self.group, hits):
            inside = set(c)
            inner = [s for (a, b), s in self.edges.items() if a in inside and b in inside]
            outer = [s for (a, b), s in self.edges.items() if not (a in inside and b in inside)]
            if len(c) >= 3 and outer and len(inner) > 1 and _reach(inner, outer) < below:
                out.append(c)
        return out


def _components(vertices: list[int], links: list[tuple[int, int]]) -> list[list[int]]:
    root = {v: v for v in vertices}

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    parts = defaultdict(list)
    for v in vertices:
        parts[find(v)].append(v)
    return sorted((sorted(p) for p in parts.values()), key=lambda p: (-len(p), p[0]))


def _density(values: list[float]) -> tuple[np.ndarray, float]:
    """Values and their bandwidth; values without spread are moved a little, up and down by turns."""
    x = np.sort(np.asarray(values, dtype=float))
    if len(x) < 2 or x[0] == x[-1]:
        x = np.concatenate([x, x]) if len(x) < 2 else x
        x = x * (1 + np.where(np.arange(len(x)) % 2 == 0, -1e-7, 1e-7))
    sd = x.std(ddof=1) or 1e-12
    return x, sd * (len(x) * 0.75) ** -0.2


def _mass(x: np.ndarray, h: float, to: float) -> float:
    """The distribution function of a Gaussian kernel density."""
    return float(np.mean([0.5 * math.erfc((v - to) / h / math.sqrt(2)) for v in x]))


def _reach(inner: list[float], outer: list[float], share: float = 0.95) -> float:
    """The mass of the outer density within the central ``share`` of the inner one."""
    (x, h), (y, g) = _density(inner), _density(outer)

    def quantile(q: float) -> float:
        low, high = x[0] - 10 * h, x[-1] + 10 * h
        for _ in range(40):
            middle = (low + high) / 2
            low, high = (middle, high) if _mass(x, h, middle) < q else (low, middle)
        return (low + high) / 2

    return _mass(y, g, quantile((1 + share) / 2)) - _mass(y, g, quantile((1 - share) / 2))

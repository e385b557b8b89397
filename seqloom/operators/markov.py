"""Markov clustering of blocks of a graph in a task's memory: dense matrices of connected parts, equal sizes stacked.

Flow never leaves a connected part, so parts are clustered apart from each other, each until its own flow
hardly changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: A value that changes by no more than this in a round has settled.
SETTLED = 1e-3
#: Edges that a task looks at together, if no block has more of them.
EDGES = 200_000
#: Numbers in a stack of matrices.
STACK = 2_000_000


def labels_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex of each vertex's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def settled_labels(m: np.ndarray, inflation: float, prune: float, rounds: int) -> np.ndarray:
    """``(stack, n)``: for stacked symmetric matrices the smallest member of each member's cluster, -1 in matrices that have not settled."""
    n = m.shape[1]
    at = np.arange(n)
    m[:, at, at] = m.max(axis=1)
    m /= m.sum(axis=1, keepdims=True)
    todo = np.arange(len(m))
    for _ in range(rounds):
        old = m[todo]
        new = np.matmul(old, old) ** inflation
        new /= new.sum(axis=1, keepdims=True)
        # a column without a value of that size keeps its largest ones
        new[new < np.minimum(new.max(axis=1, keepdims=True), prune)] = 0
        new /= new.sum(axis=1, keepdims=True)
        moving = ((np.abs(new - old) > SETTLED) & (new > 0)).any(axis=(1, 2))
        m[todo] = new
        todo = todo[moving]
        if not len(todo):
            break
    near = (m > 0) | (m > 0).transpose(0, 2, 1)
    near[:, at, at] = True
    while True:
        far = np.matmul(near.astype(np.float32), near.astype(np.float32)) > 0
        if (far == near).all():
            break
        near = far
    found = near.argmax(axis=2)
    found[todo] = -1
    return found


def clustered(a: np.ndarray, b: np.ndarray, score: np.ndarray, n: int, settings: list[tuple[float, float]], prune: float, rounds: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(k, vertices, labels)`` under each setting (inflation, edge threshold); vertices without a tied edge are left out."""
    for threshold in sorted({t for _, t in settings}):
        strong = score >= threshold
        x, y, w = a[strong], b[strong], score[strong]
        label = labels_of(x, y, n)
        order = np.argsort(label, kind="stable")
        sizes = np.bincount(label, minlength=n)
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n) - np.repeat(np.cumsum(sizes[sizes > 0]) - sizes[sizes > 0], sizes[sizes > 0])
        for size in np.unique(sizes[sizes > 1]):
            parts = np.flatnonzero(sizes == size)
            step = max(1, STACK // int(size) ** 2)
            for i in range(0, len(parts), step):
                some = parts[i : i + step]
                number = np.full(n, -1)
                number[some] = np.arange(len(some))
                of = number[label[x]]
                e = of >= 0
                m = np.zeros((len(some), size, size))
                m[of[e], place[x[e]], place[y[e]]] = w[e]
                m[of[e], place[y[e]], place[x[e]]] = w[e]
                own = np.flatnonzero(number[label] >= 0)
                vertices = np.empty((len(some), size), dtype=np.int64)
                vertices[number[label[own]], place[own]] = own
                for k, (inflation, t) in enumerate(settings):
                    if t == threshold:
                        found = settled_labels(m.copy(), inflation, prune, rounds)
                        labels = np.where(found >= 0, np.take_along_axis(vertices, np.maximum(found, 0), axis=1), -1)
                        yield k, vertices.ravel(), labels.ravel()


def cluster_blocks(settings: list[tuple[float, float]], prune: float, rounds: int):
    """For ``mapInPandas`` of ``(block, seq1, seq2, score)`` sorted by block: ``(k, member, grp)``, no group where the flow has not settled."""

    def together(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids, at = np.unique(np.concatenate([rows["seq1"].to_numpy(object), rows["seq2"].to_numpy(object)]), return_inverse=True)
        a, b = at[: len(rows)], at[len(rows) :]
        for k, vertices, labels in clustered(a, b, rows["score"].to_numpy(float), len(ids), settings, prune, rounds):
            yield pd.DataFrame({"k": np.int32(k), "member": ids[vertices], "grp": np.where(labels >= 0, ids[np.maximum(labels, 0)], None)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for batch in batches:
            if not len(batch):
                continue
            n += len(batch)
            held.append(batch)
            if n >= EDGES:
                rows = pd.concat(held, ignore_index=True)
                whole = (rows["block"] != rows["block"].iloc[-1]).to_numpy()
                if whole.any():
                    yield from together(rows[whole])
                held = [rows[~whole]]
                n = len(held[0])
        if n:
            yield from together(pd.concat(held, ignore_index=True))

    return run

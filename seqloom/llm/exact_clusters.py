"""The clusters of a small graph by exhaustive search: what a random search has left over."""

from __future__ import annotations

import math
from collections import defaultdict

#: Steps of the search in one connected part; beyond, it is an error.
MOST_STEPS = 300_000


def all_clusters(ties, least_size: int, inside_above: float, outside_at_most: float, most_steps: int = MOST_STEPS) -> list[list]:
    """Disjoint clusters that meet the conditions; afterwards no further one is possible.

    ``ties`` are ``(u, v, su, sv)``, each pair once; ends marked by ``su`` or ``sv`` can only be outsiders.
    Every size and every choice of members is tried, less those that the conditions exclude.  A search
    of more than ``most_steps`` raises; nothing is left out in silence.
    """
    near: dict = defaultdict(set)
    free: set = set()
    for u, v, su, sv in ties:
        near[u].add(v)
        near[v].add(u)
        free.update(x for x, marked in ((u, su), (v, sv)) if not marked)
    search = _Search(near, free, inside_above, outside_at_most, most_steps)
    need = math.floor(inside_above * (least_size - 1)) + 1
    found = []
    while True:
        while few := [v for v in free if len(near[v] & free) < need]:
            free.difference_update(few)
        if not free:
            return found
        seed = min(free, key=lambda v: (len(near[v] & free), v))
        got = search.around(seed, least_size)
        if got:
            found.append(sorted(got))
            free -= got
        else:
            free.discard(seed)  # in no cluster with those still free


class _Search:
    def __init__(self, near, free, inside_above, outside_at_most, most_steps):
        self.near, self.free, self.a, self.b, self.left = near, free, inside_above, outside_at_most, most_steps

    def around(self, seed, least_size: int):
        """A cluster of free records with ``seed``, or None."""
        near, free = self.near, self.free
        if self.a >= 0.5:  # two members are tied or share a tied member
            reach = {seed} | (near[seed] & free)
            reach |= {w for v in tuple(reach) for w in near[v] & free}
        else:
            reach = set(free)
        for size in range(len(reach), least_size - 1, -1):
            need = math.floor(self.a * (size - 1)) + 1
            if len(near[seed] & reach) >= need:
                got = self._try({seed}, reach - {seed}, size, need)
                if got:
                    return got
        return None

    def _try(self, chosen: set, open_: set, size: int, need: int):
        """A cluster of ``size`` members: all ``chosen`` and some of ``open_``; None where there is none."""
        near, most = self.near, math.floor(self.b * size)
        stack = [(chosen, open_)]
        while stack:
            chosen, open_ = stack.pop()
            self.left -= 1
            if self.left < 0:
                raise RuntimeError("the exact search for the remaining clusters did not end within its steps")
            if not self._narrow(chosen, open_, size, need, most):
                continue
            if len(chosen) == size:
                return chosen
            v = max(open_, key=lambda v: (len(near[v] & chosen), v))
            stack.append((set(chosen), open_ - {v}))
            stack.append((chosen | {v}, open_ - {v}))
        return None

    def _narrow(self, chosen: set, open_: set, size: int, need: int, most: int) -> bool:
        """Draws what follows from the conditions, in place; False where they cannot be met."""
        near = self.near
        while True:
            if len(chosen) > size or len(chosen) + len(open_) < size:
                return False
            if len(chosen) == size:
                open_.clear()
            elif len(chosen) + len(open_) == size:
                chosen |= open_
                open_.clear()
            room = size - len(chosen)
            add, gone = set(), set()
            for v in open_:
                have = len(near[v] & chosen)
                if have + min(len(near[v] & open_), room - 1) < need:
                    gone.add(v)
                elif have > most:
                    add.add(v)
            for v in chosen:
                have, more = len(near[v] & chosen), near[v] & open_
                if have + min(len(more), room) < need:
                    return False
                if have + len(more) == need:
                    add |= more
                elif room and have + room == need:
                    gone |= open_ - more
            if add & gone:
                return False
            if not add and not gone:
                break
            chosen |= add
            open_ -= add
            open_ -= gone
        around = {w for v in chosen for w in near[v]} - chosen - open_
        return all(len(near[w] & chosen) <= most for w in around)

"""DartMinHash: fast signatures of weighted sets.

Every element carries the same endless set of pseudo-random darts wherever it occurs.  A dart has a place
in the element's weight (it hits a set when that place lies below the element's weight there), a rank and
one of ``k`` coordinates.  The signature keeps, for every coordinate, the hit of the lowest rank; two sets
agree in a coordinate with the probability of their weighted Jaccard similarity.

The weight axis is cut at 1, 2, 4, ... and the rank axis so that every region has area one; a region holds
a Poisson(1) number of darts, all drawn from hashes of (element, region, dart).  Only darts below a rank
bound are thrown: ``k ln k + 2k`` hits are expected, which leaves hardly a coordinate empty; a set with
an empty one gets more.  So the work is O(k log k) a set, plus one step an element, not k steps an element.
"""

from __future__ import annotations

import math

import numpy as np

_U = np.uint64
_MIX1, _MIX2, _STEP = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
#: The number of darts of a region by 16 bits of its hash: Poisson(1), rounded to 2^-16.
_COUNTS = np.searchsorted([sum(math.exp(-1) / math.factorial(j) for j in range(n + 1)) for n in range(9)], (np.arange(65536) + 0.5) / 65536).astype(np.uint8)
EMPTY = _U(2**64 - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with good avalanche."""
    x = x ^ (x >> _U(30))
    x *= _MIX1
    x ^= x >> _U(27)
    x *= _MIX2
    x ^= x >> _U(31)
    return x


def signatures(row: np.ndarray, element: np.ndarray, n_rows: int, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """``(n_rows, k)`` signatures of the sets given as (row, element hash[, weight > 0]).

    Without weights, an element that is given several times in a row counts once.  The value of a
    coordinate identifies the dart.  A row without elements keeps ``EMPTY`` everywhere.
    """
    out = np.full(n_rows * k, EMPTY, dtype=np.uint64)
    mass = np.bincount(row, weights=weight, minlength=n_rows)
    low = np.zeros(n_rows, dtype=np.int64)
    bound = np.ceil((k * math.log(k) + 2 * k) / np.where(mass > 0, mass, np.inf)).astype(np.int64)
    todo = mass > 0
    while todo.any():
        if todo.all():
            _throw(out, row, element, weight, low, bound, k)
        else:
            use = todo[row]
            _throw(out, row[use], element[use], None if weight is None else weight[use], low, bound, k)
        todo &= (out.reshape(n_rows, k) == EMPTY).any(axis=1)
        low, bound = bound, np.where(todo, 2 * bound, bound)
    return out.reshape(n_rows, k)


def _throw(out: np.ndarray, row: np.ndarray, element: np.ndarray, weight: np.ndarray | None, low: np.ndarray, bound: np.ndarray, k: int) -> None:
    """All darts with low <= rank < bound of the row that hit it, into ``out``."""
    start, strip, shift = 0.0, 0, 0  # the weight strip [0, 1), then [1, 2), [2, 4), ... of width 2^shift
    base = row * k
    while len(base):
        cells = (bound - low)[row] << shift
        which = np.repeat(np.arange(len(base)), cells)
        ends = np.cumsum(cells)
        cell = np.arange(len(which)) - np.repeat(ends - cells - (low[row] << shift), cells)
        salt = mix(_STEP * (np.arange(int(cell.max()) + 1, dtype=np.uint64) * _U(64) + _U(strip + 1)))
        region = mix(element[which] ^ salt[cell])
        count = _COUNTS[region >> _U(48)]
        height = cell.astype(np.uint64) << _U(24)
        at = base[which]
        for j in range(int(count.max(initial=0))):
            hit = np.flatnonzero(count > j)
            dart = mix(region[hit] + _U((j + 1) * int(_STEP) % 2**64))
            # the rank in 40 bits, in units of 2^-24; then 24 bits that name the dart
            value = (((height[hit] | (dart >> _U(40))) >> _U(shift)) << _U(24)) | (dart & _U(0xFFFFFF))
            place = at[hit] + ((((dart >> _U(8)) & _U(0xFFFFFFFF)) * _U(k)) >> _U(32)).astype(np.int64)
            if weight is not None:
                level = start + (mix(dart ^ _STEP) >> _U(11)).astype(np.float64) * 2.0**-53 * 2.0**shift
                below = level < weight[which[hit]]
                value, place = value[below], place[below]
            np.minimum.at(out, place, value)
        if weight is None:
            return
        start, strip = start + 2.0**shift, strip + 1
        shift = max(0, strip - 1)
        more = weight > start
        row, base, element, weight = row[more], base[more], element[more], weight[more]


def bands(signature: np.ndarray, rows_per_band: int) -> np.ndarray:
    """``(n, bands)``: a hash of every band of a signature, different for each band number."""
    n, k = signature.shape
    parts = signature.reshape(n, k // rows_per_band, rows_per_band)
    h = np.broadcast_to(mix(np.arange(1, k // rows_per_band + 1, dtype=np.uint64) * _STEP), parts.shape[:2])
    for j in range(rows_per_band):
        h = mix(h ^ (parts[:, :, j] + _U((j + 1) * int(_STEP) % 2**64)))
    return h

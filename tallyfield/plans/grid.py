"""Lattices that turn a distance join into an equi-join of cells."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from tallyfield.plans.points import Extent


#: Cells on an axis at most; the key of three axes is a long.
MAX_CELLS = 1 << 20


@dataclass(frozen=True)
class Grid:
    """Cells at least as wide as the reach on each axis, so that partners are in neighbouring cells."""

    origin: tuple[float, float, float]
    size: tuple[float, float, float]
    n: tuple[int, int, int]
    wrap: tuple[float | None, float | None, float | None]

    @staticmethod
    def plan(extent: Extent, reach: tuple[float, float, float], wrap: tuple[float | None, ...], max_cells: int = MAX_CELLS) -> Grid:
        origin, size, n = [], [], []
        for lo, hi, r, length in zip(extent.low, extent.high, reach, wrap):
            if length is not None and r >= length / 2:
                raise ValueError(f"the largest separation {r} must be under half the box {length}")
            span = length if length is not None else max(hi - lo, 1e-300)
            cells = max(1, min(max_cells, int(span / r)))
            origin.append(lo)
            n.append(cells)
            size.append(span / cells)
        return Grid(tuple(origin), tuple(size), tuple(n), tuple(wrap))

    def _axis(self, c: Column, i: int) -> Column:
        v = c - self.origin[i]
        if self.wrap[i] is not None:
            v = F.pmod(v, F.lit(self.wrap[i]))
        k = F.floor(v / self.size[i]).cast("int")
        return F.greatest(F.lit(0), F.least(F.lit(self.n[i] - 1), k))

    def cell(self, x: Column, y: Column, z: Column) -> list[Column]:
        return [self._axis(c, i) for i, c in enumerate((x, y, z))]

    def key(self, cell: list[Column]) -> Column:
        a, b, c = (v.cast("long") for v in cell)
        return (a * self.n[1] + b) * self.n[2] + c

    def neighbours(self, cell: list[Column]) -> Column:
        """Keys of the neighbouring cells, the own one first."""
        keys = []
        for offset in itertools.product((0, 1, -1), repeat=3):
            if any(d and n == 1 for d, n in zip(offset, self.n)):
                continue
            moved, inside = [], F.lit(True)
            for c, d, n, w in zip(cell, offset, self.n, self.wrap):
                v = c + d
                if w is not None:
                    v = F.pmod(v, F.lit(n)) if d else c
                elif d:
                    inside = inside & (v >= 0) & (v < n)
                moved.append(v)
            keys.append(F.when(inside, self.key(moved)))
        found = F.array_compact(F.array(*keys))
        # two neighbours of a periodic axis of two cells are one
        return found if all(w is None or n >= 3 for w, n in zip(self.wrap, self.n)) else F.array_distinct(found)

    def separation(self, a: Column, b: Column, axis: int) -> Column:
        """Distance along an axis, by the nearest image where it is periodic."""
        d = F.abs(a - b)
        length = self.wrap[axis]
        return d if length is None else F.when(d >= length / 2, length - d).otherwise(d)

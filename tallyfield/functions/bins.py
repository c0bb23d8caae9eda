"""Bin edges: reading, checking, and the bins of values."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np


def parse_bins(text: str) -> list[float]:
    """Edges from lines of ``lo hi``; blank lines and ``#`` comments don't count.

    The first edge is the first ``lo``, the others are the ``hi``; contiguity is
    taken for granted.
    """
    rows = [line.split() for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]
    if not rows:
        raise ValueError("no bins")
    return [float(rows[0][0]), *(float(r[1]) for r in rows)]


def normalize_bins(spec: str | Iterable[float]) -> list[float]:
    """Rising edges from a bin file's path, or from edges in any order."""
    if isinstance(spec, str):
        with open(spec, encoding="utf-8") as f:
            edges = parse_bins(f.read())
    else:
        edges = sorted(float(e) for e in spec)
    if len(edges) < 2:
        raise ValueError("at least two edges are needed")
    if any(not a < b for a, b in zip(edges, edges[1:])):
        raise ValueError("edges must rise")
    return edges


def logbins(low: float, high: float, n: int) -> list[float]:
    """``n`` bins of equal width in the logarithm: ``n + 1`` edges."""
    if not (0 < low < high and n > 0):
        raise ValueError("0 < low < high and n > 0 are needed")
    step = (high / low) ** (1.0 / n)
    return [low * step**i for i in range(n)] + [high]


def binned(value: np.ndarray, edges: Sequence[float]) -> np.ndarray:
    """Number from 0 of the half-open bin that each value, known to lie within, falls in."""
    return np.searchsorted(np.asarray(edges[1:-1], float), value, "right")

"""Pair counts and correlation functions of points in Cartesian coordinates.

``points`` have columns ``id, x, y, z, w`` (see ``plans.points.xyz``).  Intervals
are half open.  A set counted with itself counts each pair in both orders; if the
first edge is zero, each point with itself too.  All bins are in the result.

``cells`` are the options of ``paircount.lattice``: ``xbin_refine_factor`` and its
like, ``max_cells_per_dim`` and ``enable_min_sep_opt``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tallyfield.functions.bins import binned, normalize_bins
from tallyfield.operators.paircount import Counts, count_pairs, dense, lattice
from tallyfield.plans.kernel import Binned


def _checked(bins, least_ok: bool = True) -> list[float]:
    edges = normalize_bins(bins)
    if edges[0] < 0 or (not least_ok and edges[0] <= 0):
        raise ValueError("the first edge must be " + ("at least" if least_ok else "above") + " zero")
    return edges


def _squares(edges: list[float]) -> list[float]:
    return [e * e for e in edges]


def _radial(edges: list[float]):
    sq = _squares(edges)

    def metric(dx, dy, dz):
        r2 = dx * dx + dy * dy + dz * dz
        kept = np.flatnonzero((r2 >= sq[0]) & (r2 < sq[-1]))
        r2 = r2[kept]
        return kept, binned(r2, sq), lambda: np.sqrt(r2)

    return Binned("square", metric, tuple(sq), np.sqrt)


def _projected(edges: list[float], pimax: float, bins: int):
    """Bins across the line of sight, times ``bins`` along it."""
    sq, scale = _squares(edges), 1.0 / (pimax / bins)

    def metric(dx, dy, dz):
        r2 = dx * dx + dy * dy
        kept = np.flatnonzero((dz < pimax) & (r2 >= sq[0]) & (r2 < sq[-1]))
        r2 = r2[kept]
        return kept, binned(r2, sq) * bins + layer(dz[kept] * scale, bins), lambda: np.sqrt(r2)

    return Binned("across", metric, tuple(sq), np.sqrt, (bins, scale, pimax))


def layer(value: np.ndarray, bins: int) -> np.ndarray:
    """The bin of a value in units of bins; roundoff at the end stays in the last one."""
    return np.minimum(value.astype(np.int64), bins - 1)


def pi_bins(pimax: float) -> int:
    if int(pimax) < 1:
        raise ValueError("pimax must be at least 1")
    return int(pimax)


def DD(points: DataFrame, bins, other: DataFrame | None = None, *, periodic: bool = True, boxsize=None, weight_type=None, output_ravg: bool = False, **cells) -> DataFrame:
    """Counts by separation: ``rmin, rmax, ravg, npairs, weightavg``."""
    edges = _checked(bins)
    found = count_pairs(points, other, (edges[-1],) * 3, _radial(edges), (len(edges) - 1,), periodic=periodic, boxsize=boxsize, weight_type=weight_type, average=output_ravg, cells=lattice(**cells), self_pairs=edges[0] <= 0)
    return dense(found.table, edges, ("rmin", "rmax", "ravg"), bool(weight_type))


def DDrppi(points: DataFrame, pimax: float, bins, other: DataFrame | None = None, *, periodic: bool = True, boxsize=None, weight_type=None, output_rpavg: bool = False, **cells) -> DataFrame:
    """Counts by projected and line-of-sight separation: ``rmin, rmax, rpavg, pimax, npairs, weightavg``."""
    edges, n = _checked(bins), pi_bins(pimax)
    found = count_pairs(points, other, (edges[-1], edges[-1], pimax), _projected(edges, pimax, n), (len(edges) - 1, n), ball=False, periodic=periodic, boxsize=boxsize, weight_type=weight_type, average=output_rpavg, cells=lattice(**cells), self_pairs=edges[0] <= 0)
    return dense(found.table, edges, ("rmin", "rmax", "rpavg"), bool(weight_type), ("pimax", [(j + 1) * (pimax / n) for j in range(n)]))


def DDsmu(points: DataFrame, bins, mu_max: float, nmu_bins: int, other: DataFrame | None = None, *, periodic: bool = True, boxsize=None, weight_type=None, output_savg: bool = False, **cells) -> DataFrame:
    """Counts by separation and cosine to the line of sight (z): ``smin, smax, savg, mu_max, npairs, weightavg``.

    Coincident points have no cosine; they count as mu = 0 where the first edge is zero.
    """
    edges = _checked(bins)
    check_mu(mu_max, nmu_bins)
    sq, dmu = _squares(edges), mu_max / nmu_bins

    def metric(dx, dy, dz):
        s2, z2 = dx * dx + dy * dy + dz * dz, dz * dz
        kept = np.flatnonzero((s2 >= sq[0]) & (s2 < sq[-1]) & ((z2 < s2 * (mu_max * mu_max)) | (s2 == 0)))
        s2, z2 = s2[kept], z2[kept]
        mu = np.sqrt(z2 / np.where(s2 > 0, s2, 1.0))
        return kept, binned(s2, sq) * nmu_bins + layer(mu * (1.0 / dmu), nmu_bins), lambda: np.sqrt(s2)

    found = count_pairs(points, other, (edges[-1],) * 3, metric, (len(edges) - 1, nmu_bins), periodic=periodic, boxsize=boxsize, weight_type=weight_type, average=output_savg, cells=lattice(**cells), self_pairs=edges[0] <= 0)
    return dense(found.table, edges, ("smin", "smax", "savg"), bool(weight_type), ("mu_max", [(j + 1) * dmu for j in range(nmu_bins)]))


def check_mu(mu_max: float, nmu_bins: int) -> None:
    if not 0 < mu_max <= 1 or nmu_bins < 1:
        raise ValueError("0 < mu_max <= 1 and at least one mu bin are needed")


def _natural(found: Counts, table: DataFrame, lo: str, hi: str, volume, name: str, scale: float, boxsize: float, weighted: bool) -> DataFrame:
    """The correlation function against the count expected of uniform points; -2 for bins without volume."""
    n = float(found.first.n)
    total, squares = (found.first.sum_w, found.first.sum_w2) if weighted else (n, n)
    density = total * (total - total / n) / boxsize**3 if n else 0.0
    v = volume(F.col(lo), F.col(hi))
    expected = density * v + F.when(F.col(lo) <= 0, F.lit(float(squares))).otherwise(0.0)
    counted = F.col("npairs") * F.col("weightavg") if weighted else F.col("npairs").cast("double")
    value = F.when(v > 0, (F.try_divide(counted, expected) - 1.0) * scale).otherwise(-2.0)
    return table.withColumn(name, value)


def wp(points: DataFrame, boxsize: float, pimax: float, bins, *, weight_type=None, output_rpavg: bool = False, **cells) -> DataFrame:
    """Projected correlation function in a periodic cube: ``rmin, rmax, rpavg, wp, npairs, weightavg``."""
    edges = _checked(bins)
    found = count_pairs(points, None, (edges[-1], edges[-1], pimax), _projected(edges, pimax, 1), (len(edges) - 1,), ball=False, periodic=True, boxsize=boxsize, weight_type=weight_type, average=output_rpavg, cells=lattice(**cells), self_pairs=edges[0] <= 0, domain=boxsize)
    table = dense(found.table, edges, ("rmin", "rmax", "rpavg"), bool(weight_type))
    out = _natural(found, table, "rmin", "rmax", lambda lo, hi: math.pi * (hi * hi - lo * lo) * 2 * pimax, "wp", 2.0 * pimax, boxsize, bool(weight_type))
    return out.select("rmin", "rmax", "rpavg", "wp", "npairs", "weightavg")


def xi(points: DataFrame, boxsize: float, bins, *, weight_type=None, output_ravg: bool = False, **cells) -> DataFrame:
    """Correlation function in a periodic cube: ``rmin, rmax, ravg, xi, npairs, weightavg``."""
    edges = _checked(bins)
    found = count_pairs(points, None, (edges[-1],) * 3, _radial(edges), (len(edges) - 1,), periodic=True, boxsize=boxsize, weight_type=weight_type, average=output_ravg, cells=lattice(**cells), self_pairs=edges[0] <= 0, domain=boxsize)
    table = dense(found.table, edges, ("rmin", "rmax", "ravg"), bool(weight_type))
    out = _natural(found, table, "rmin", "rmax", lambda lo, hi: 4.0 / 3.0 * math.pi * (hi * hi * hi - lo * lo * lo), "xi", 1.0, boxsize, bool(weight_type))
    return out.select("rmin", "rmax", "ravg", "xi", "npairs", "weightavg")

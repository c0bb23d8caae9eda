"""Pair counts of points on the sky: right ascension and declination in degrees, and redshift or distance.

Point sets have ``id, ra, dec, cz, w`` (``cz`` unused by angular counts).
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from tallyfield.functions.bins import binned, normalize_bins
from tallyfield.functions.sky import degrees_between, fix_cz, fix_ra_dec, unit_vector, with_distance
from tallyfield.operators.paircount import count_pairs, dense, lattice
from tallyfield.operators.theory import check_mu, layer, pi_bins
from tallyfield.plans.kernel import Binned
from tallyfield.plans.points import weights_of

#: Below this angle, and above this mu, single precision loses digits.
SMALL_THETA, LARGE_MU = 0.2, 0.9800666


def sky(df: DataFrame, ra: str = "ra", dec: str = "dec", cz: str | None = "cz", weights: str | None = None, id: str | None = None) -> DataFrame:
    """``id, ra, dec, cz, w[, ws]`` of any table; columns of single precision are marked, so that counters can warn."""
    number = F.col(id).cast("long") if id else F.monotonically_increasing_id()

    def marked(column: str, name: str):
        return F.col(column).cast("double").alias(name, metadata={"single": isinstance(df.schema[column].dataType, T.FloatType)})

    distance = marked(cz, "cz") if cz else F.lit(0.0).alias("cz")
    return df.select(number.alias("id"), marked(ra, "ra"), marked(dec, "dec"), distance, *weights_of(df, weights))


def _single(points: DataFrame, columns: tuple[str, ...]) -> bool:
    fields = [points.schema[c] for c in columns]
    return any(isinstance(f.dataType, T.FloatType) or (f.metadata or {}).get("single") for f in fields)


def cartesian(points: DataFrame, cosmology: int, is_comoving_dist: bool, fix: bool = True) -> DataFrame:
    """``id, x, y, z, w[, ws]`` at comoving distances."""
    if fix:
        points = fix_ra_dec(points)
    if is_comoving_dist:
        points = points.withColumn("dist", F.col("cz"))
    else:
        points = with_distance(fix_cz(points) if fix else points, cosmology)
    x, y, z = unit_vector(F.col("ra"), F.col("dec"))
    return points.select("id", *[(v * F.col("dist")).alias(n) for v, n in ((x, "x"), (y, "y"), (z, "z"))], *weight_columns(points))


def weight_columns(points: DataFrame) -> list[str]:
    return [c for c in ("w", "ws") if c in points.columns]


def _positive(bins) -> list[float]:
    edges = normalize_bins(bins)
    if edges[0] <= 0:
        raise ValueError("the first edge must be above zero")
    return edges


def _sight(ax, ay, az, bx, by, bz):
    """Squares of the separation, of the sum of positions, and of their product."""
    dx, dy, dz, lx, ly, lz = bx - ax, by - ay, bz - az, bx + ax, by + ay, bz + az
    sl = dx * lx + dy * ly + dz * lz
    return dx * dx + dy * dy + dz * dz, lx * lx + ly * ly + lz * lz, sl * sl


def DDrppi_mocks(points: DataFrame, cosmology: int, pimax: float, bins, other: DataFrame | None = None, *, is_comoving_dist: bool = False, weight_type=None, output_rpavg: bool = False, **cells) -> DataFrame:
    """Counts by separation across and along the line of sight: ``rmin, rmax, rpavg, pimax, npairs, weightavg``."""
    edges, n = _positive(bins), pi_bins(pimax)
    sq = [e * e for e in edges]

    scale = 1.0 / (pimax / n)

    def metric(*v):
        s2, l2, sl2 = _sight(*v)
        par2 = sl2 / np.where(l2 > 0, l2, 1.0)
        rp2 = s2 - par2
        kept = np.flatnonzero((s2 < sq[-1] + pimax * pimax) & (sl2 < l2 * (pimax * pimax)) & (rp2 >= sq[0]) & (rp2 < sq[-1]))
        rp2 = rp2[kept]
        return kept, binned(rp2, sq) * n + layer(np.sqrt(par2[kept]) * scale, n), lambda: np.sqrt(rp2)

    a = cartesian(points, cosmology, is_comoving_dist)
    b = None if other is None else cartesian(other, cosmology, is_comoving_dist)
    reach = math.hypot(edges[-1], pimax)
    found = count_pairs(a, b, (reach,) * 3, metric, (len(edges) - 1, n), weight_type=weight_type, average=output_rpavg, coordinates=True, cells=lattice(**cells))
    return dense(found.table, edges, ("rmin", "rmax", "rpavg"), bool(weight_type), ("pimax", [(j + 1) * (pimax / n) for j in range(n)]))


def DDsmu_mocks(points: DataFrame, cosmology: int, mu_max: float, nmu_bins: int, bins, other: DataFrame | None = None, *, is_comoving_dist: bool = False, weight_type=None, output_savg: bool = False, **cells) -> DataFrame:
    """Counts by separation and cosine to the line of sight: ``smin, smax, savg, mumax, npairs, weightavg``."""
    edges = _positive(bins)
    check_mu(mu_max, nmu_bins)
    if mu_max >= LARGE_MU and _single(points, ("ra", "dec", "cz")):
        warnings.warn("single-precision positions make large mu inexact", stacklevel=2)
    sq, dmu = [e * e for e in edges], mu_max / nmu_bins

    def metric(*v):
        s2, l2, sl2 = _sight(*v)
        both = l2 * s2
        mu2 = sl2 / np.where(both > 0, both, 1.0)
        kept = np.flatnonzero((s2 >= sq[0]) & (s2 < sq[-1]) & (mu2 < mu_max * mu_max))
        s2 = s2[kept]
        return kept, binned(s2, sq) * nmu_bins + layer(np.sqrt(mu2[kept]) * (1.0 / dmu), nmu_bins), lambda: np.sqrt(s2)

    a = cartesian(points, cosmology, is_comoving_dist)
    b = None if other is None else cartesian(other, cosmology, is_comoving_dist)
    found = count_pairs(a, b, (edges[-1],) * 3, metric, (len(edges) - 1, nmu_bins), weight_type=weight_type, average=output_savg, coordinates=True, cells=lattice(**cells))
    return dense(found.table, edges, ("smin", "smax", "savg"), bool(weight_type), ("mumax", [(j + 1) * dmu for j in range(nmu_bins)]))


def _directions(df: DataFrame) -> DataFrame:
    df = fix_ra_dec(df)
    return df.select("id", *[v.alias(n) for v, n in zip(unit_vector(F.col("ra"), F.col("dec")), "xyz")], *weight_columns(df))


def DDtheta_mocks(points: DataFrame, bins, other: DataFrame | None = None, *, weight_type=None, output_thetaavg: bool = False, fast_acos: bool = False, everything: bool = False, **cells) -> DataFrame:
    """Counts by angle in degrees: ``thetamin, thetamax, thetaavg, npairs, weightavg``.

    ``fast_acos`` takes the mean angle from a polynomial; counts don't depend on it.
    ``everything`` lets all directions meet, whatever the largest angle.

    Directions are unit vectors in a lattice of their chord, so neither poles nor
    the origin of right ascension need care.
    """
    edges = normalize_bins(bins)
    if edges[0] < 0 or edges[-1] > 180:
        raise ValueError("angles are from 0 to 180 degrees")
    if edges[0] <= SMALL_THETA and _single(points, ("ra", "dec")):
        warnings.warn("single-precision directions make small angles inexact", stacklevel=2)
    cosines = [math.cos(math.radians(e)) for e in edges]

    falling = [-c for c in cosines]

    def metric(ax, ay, az, bx, by, bz):
        cosine = ax * bx + ay * by + az * bz
        keep = cosine > cosines[-1]
        if edges[0] > 0:
            keep &= cosine <= cosines[0]
        kept = np.flatnonzero(keep)
        cosine = cosine[kept]
        return kept, binned(-cosine, falling), lambda: degrees_between(cosine, fast_acos)

    # with self pairs no cosine is too large
    metric = Binned("dot", metric, (falling[0] if edges[0] > 0 else -math.inf, *falling[1:]), lambda value: degrees_between(-value, fast_acos))
    chord = 2.0 if everything else 2 * math.sin(math.radians(min(edges[-1], 180.0)) / 2) * (1 + 1e-9) + 1e-12
    found = count_pairs(_directions(points), None if other is None else _directions(other), (chord,) * 3, metric, (len(edges) - 1,), weight_type=weight_type, average=output_thetaavg, coordinates=True, cells=lattice(**cells), self_pairs=edges[0] <= 0)
    return dense(found.table, edges, ("thetamin", "thetamax", "thetaavg"), bool(weight_type))


def DDtheta_brute_force(points: DataFrame, bins, other: DataFrame | None = None, **options) -> DataFrame:
    """``DDtheta_mocks`` without cells: every pair is looked at, in chunks dealt over the tasks.

    Takes as long as there are pairs; a check of the lattice, for small sets.
    """
    return DDtheta_mocks(points, bins, other, max_cells_per_dim=1, enable_min_sep_opt=False, everything=True, **options)

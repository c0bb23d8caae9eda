"""Sky coordinates and cosmological distances."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Kilometres a second.
LIGHT_SPEED = 299800.0
#: Matter and dark-energy densities by number of the cosmology.
COSMOLOGIES = {1: (0.25, 0.75), 2: (0.302, 1.0 - 0.302)}
#: Redshifts of the table, and sub-steps of the integral between two of them.
TABLE_STEP, TABLE_SIZE, SUBSTEPS = 1e-4, 10_000, 50


def distance_table(cosmology: int) -> np.ndarray:
    """Comoving distance for redshifts 0, 1e-4, ... 1, in units for h = 1, by Simpson's rule."""
    if cosmology not in COSMOLOGIES:
        raise ValueError(f"cosmology must be one of {sorted(COSMOLOGIES)}")
    matter, dark = COSMOLOGIES[cosmology]
    z = np.linspace(0.0, TABLE_STEP * TABLE_SIZE, 2 * SUBSTEPS * TABLE_SIZE + 1)
    f = 1.0 / np.sqrt(matter * (1 + z) ** 3 + dark)
    h = z[1] - z[0]
    panels = h / 3 * (f[:-2:2] + 4 * f[1:-1:2] + f[2::2])
    total = np.r_[0.0, np.cumsum(panels.reshape(TABLE_SIZE, SUBSTEPS).sum(axis=1))]
    return LIGHT_SPEED * 0.01 * total


def distance_slopes(cosmology: int) -> np.ndarray:
    """Growth of the distance over a step of the table, at each of its redshifts."""
    matter, dark = COSMOLOGIES[cosmology]
    z = np.linspace(0.0, TABLE_STEP * TABLE_SIZE, TABLE_SIZE + 1)
    return LIGHT_SPEED * 0.01 * TABLE_STEP / np.sqrt(matter * (1 + z) ** 3 + dark)


def with_distance(points: DataFrame, cosmology: int, cz: str = "cz", out: str = "dist") -> DataFrame:
    """``out``: comoving distance, interpolated in a table of 10,001 rows that is broadcast.

    Cubics through distances and slopes are exact to roundoff; straight lines are
    not (4e-6), and move pairs across edges.
    """
    spark = points.sparkSession
    table, slopes = distance_table(cosmology), distance_slopes(cosmology)
    steps, before, after = np.diff(table), slopes[:-1], slopes[1:]
    cubic = np.stack([table[:-1], before, 3 * steps - 2 * before - after, before + after - 2 * steps], 1)
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cubic.tolist())], "__k int, __c0 double, __c1 double, __c2 double, __c3 double")
    z = F.col(cz) / LIGHT_SPEED
    at = z / TABLE_STEP
    marked = points.withColumn("__k", F.least(F.floor(at), F.lit(TABLE_SIZE - 1)).cast("int"))
    joined = marked.join(F.broadcast(rows), "__k", "left")
    value, t = F.col("__c3"), at - F.col("__k")
    for c in ("__c2", "__c1", "__c0"):
        value = value * t + F.col(c)
    checked = F.when((z >= 0) & (z <= TABLE_STEP * TABLE_SIZE), value).otherwise(F.raise_error(F.lit("a redshift is outside 0 to 1")).cast("double"))
    return joined.withColumn(out, checked).drop("__k", "__c0", "__c1", "__c2", "__c3")


def unit_vector(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    """Unit vector of a direction in degrees."""
    a, d = F.radians(ra), F.radians(dec)
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def fix_cz(points: DataFrame, cz: str = "cz") -> DataFrame:
    """If no value reaches 10 they are redshifts, and all are multiplied by the speed of light."""
    most = points.agg(F.max(cz)).first()[0]
    return points.withColumn(cz, F.col(cz) * LIGHT_SPEED) if most is not None and most < 10 else points


def fix_ra_dec(points: DataFrame, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """A negative right ascension moves all by 180 degrees, a declination over 90 all by -90."""
    low, high, worst = points.agg(F.min(ra), F.max(dec), F.min(dec)).first()
    if low is not None and low < 0:
        points = points.withColumn(ra, F.col(ra) + 180.0)
    if high is not None and high > 180:
        raise ValueError("a declination is over 180")
    if high is not None and high > 90:
        points = points.withColumn(dec, F.col(dec) - 90.0)
    return points


@functools.cache
def _acos_coefficients(degree: int = 8) -> tuple[float, ...]:
    """Of the polynomial p with acos(x) = sqrt(1 - x) p(x) on [0, 1], interpolated at Chebyshev nodes."""

    def smooth(x: np.ndarray) -> np.ndarray:
        return np.where(x < 1, np.arccos(x) / np.sqrt(np.maximum(1 - x, 1e-300)), np.sqrt(2.0))

    return tuple(np.polynomial.Chebyshev.interpolate(smooth, degree, domain=[0, 1]).convert(kind=np.polynomial.Polynomial).coef)


def fast_acos(x: np.ndarray) -> np.ndarray:
    """Arc cosine by a polynomial, within 1e-8 of the exact one; multiplications and a root only."""
    y, value = np.abs(x), 0.0
    for c in reversed(_acos_coefficients()):
        value = value * y + c
    positive = np.sqrt(1.0 - y) * value
    return np.where(x >= 0, positive, np.pi - positive)


def degrees_between(cosine: np.ndarray, fast: bool = False) -> np.ndarray:
    """Degrees from cosines, which roundoff may have carried past 1."""
    return np.degrees((fast_acos if fast else np.arccos)(np.clip(cosine, -1.0, 1.0)))

"""Counts in cells: how many points random spheres hold."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from tallyfield.operators.mocks import cartesian
from tallyfield.plans.grid import MAX_CELLS, Grid
from tallyfield.plans.points import Extent
from tallyfield.plans.tiles import wrap_lengths
from tallyfield.sources.catalogs import read_centers, write_centers

#: Centres up to which they and their 27 cells, 40 bytes each, go to all tasks; more meet the points by a shuffle.
BROADCAST = 20_000


def random_centers(n: int, seed: int, low, length, margin: float | None = None) -> np.ndarray:
    """``n`` centres from the MT19937 stream of the seed, three draws each, uniform in the box.

    With ``margin``, those nearer than that to a side are drawn again.
    """
    rng = np.random.RandomState(seed & 0xFFFFFFFF)
    if margin is not None and any(2 * margin >= s for s in length):
        raise ValueError("spheres don't fit into the points' extent")
    found = np.zeros((0, 3))
    while len(found) < n:
        u = rng.randint(0, 2**32, size=(n, 3), dtype=np.uint32) / 2.0**32
        c = u * np.asarray(length) + np.asarray(low)
        if margin is not None:
            edge = np.minimum(c - np.asarray(low), np.asarray(low) + np.asarray(length) - c)
            c = c[(edge >= margin).all(axis=1)]
        found = np.concatenate([found, c])
    return found[:n]


def _near(centers: DataFrame, points: DataFrame, grid: Grid, rmax: float, n: int) -> DataFrame:
    """``cid, r2`` of each point within ``rmax`` of each of at most ``n`` centres."""
    left = centers.select("cid", *[F.col(v).alias(f"a_{v}") for v in "xyz"], F.explode(grid.neighbours(grid.cell(F.col("x"), F.col("y"), F.col("z")))).alias("k"))
    right = points.select(*[F.col(v).alias(f"b_{v}") for v in "xyz"], grid.key(grid.cell(F.col("x"), F.col("y"), F.col("z"))).alias("k"))
    d = [grid.separation(F.col(f"a_{v}"), F.col(f"b_{v}"), i) for i, v in enumerate("xyz")]
    r2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    # never by the size that is guessed for the exploded side
    joined = right.join(F.broadcast(left), "k") if n <= BROADCAST else right.hint("merge").join(left, "k")
    return joined.select("cid", r2.alias("r2")).where(F.col("r2") < rmax * rmax)


def _probabilities(centers: DataFrame, near: DataFrame, rmax: float, nbins: int, numpN: int, total: int) -> DataFrame:
    """``rmax, pN``: for each radius the shares of spheres with 0, 1, ... points."""
    step = rmax / nbins
    binned = near.groupBy("cid", F.least(F.floor(F.sqrt("r2") * (1.0 / step)).cast("int"), F.lit(nbins - 1)).alias("bin")).count()
    radii = centers.sparkSession.range(nbins).select(F.col("id").cast("int").alias("bin"))
    # every sphere at every radius, also those without points; a running sum over the radii
    every = centers.select("cid", F.explode(F.sequence(F.lit(0), F.lit(nbins - 1))).alias("bin"))
    held = every.join(binned, ["cid", "bin"], "left").select("cid", "bin", F.sum(F.coalesce("count", F.lit(0))).over(W.partitionBy("cid").orderBy("bin")).alias("n"))
    shares = held.groupBy("bin").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(numpN)])
    pn = F.array(*[F.coalesce(F.col(f"n{i}"), F.lit(0)) / float(max(1, total)) for i in range(numpN)])
    return radii.join(shares, "bin", "left").select(((F.col("bin") + 1) * step).alias("rmax"), pn.alias("pN"), "bin").orderBy("bin").drop("bin")


def _checked(rmax: float, nbins: int, nspheres: int, numpN: int) -> None:
    if rmax <= 0 or nbins < 1 or nspheres < 1 or numpN < 1:
        raise ValueError("rmax, nbins, nspheres and numpN must be positive")


def _given(spark, centers: DataFrame | str | None, rmax: float, nspheres: int) -> DataFrame | None:
    """Centres as rows, or from a file of them if it has enough that are large enough."""
    return read_centers(spark, centers, rmax, nspheres) if isinstance(centers, str) else centers


def vpf(points: DataFrame, rmax: float, nbins: int, nspheres: int, numpN: int, seed: int, *, periodic: bool = True, boxsize=None, centers: DataFrame | str | None = None, max_cells_per_dim: int = MAX_CELLS) -> DataFrame:
    """``rmax, pN`` for ``nbins`` radii up to ``rmax``; ``pN[i]`` is the share of spheres with exactly i points.

    Centres are random in the box (with open sides, no sphere leaves the points'
    extent), or the rows ``cid, x, y, z`` of ``centers``.  If ``centers`` is a path,
    it is used if it holds ``nspheres`` spheres of at least ``rmax``, and written
    with the random ones otherwise.
    """
    _checked(rmax, nbins, nspheres, numpN)
    spark, extent = points.sparkSession, Extent.of(points)
    if not extent.n:
        raise ValueError("there are no points")
    wrap = wrap_lengths(extent, boxsize, periodic)
    length = [w if w is not None else hi - lo for w, lo, hi in zip(wrap, extent.low, extent.high)]
    given = _given(spark, centers, rmax, nspheres)
    if given is None:
        drawn = random_centers(nspheres, seed, extent.low, length, None if periodic else rmax)
        chosen, total = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(drawn)], "cid long, x double, y double, z double"), nspheres
        if isinstance(centers, str):
            write_centers(chosen, centers, rmax)
    else:
        chosen = given.select("cid", "x", "y", "z").orderBy("cid").limit(nspheres)
        total = chosen.count()
    grid = Grid.plan(extent, (rmax,) * 3, wrap, max_cells_per_dim)
    return _probabilities(chosen, _near(chosen, points, grid, rmax, nspheres), rmax, nbins, numpN, total)


def accepted_centers(randoms: DataFrame, rmax: float, nspheres: int, threshold: int, candidates: DataFrame | None = None, max_cells_per_dim: int = MAX_CELLS) -> DataFrame:
    """``cid, x, y, z`` of the first ``nspheres`` candidates with more than ``threshold`` random points within ``rmax``.

    Candidates are the random points in order of their ids, or given.  They are
    tried in growing batches by id until enough are found or none is left, so
    neighbours are counted for about as many as are needed.
    """
    extent = Extent.of(randoms)
    tries = randoms.select(F.col("id").alias("cid"), "x", "y", "z") if candidates is None else candidates.select("cid", "x", "y", "z")
    grid = Grid.plan(extent, (rmax,) * 3, (None,) * 3, max_cells_per_dim)
    found: list = []
    last, size = None, 2 * nspheres
    while len(found) < nspheres:
        batch = tries if last is None else tries.where(F.col("cid") > last)
        # a multiple of the spheres asked for, which the result holds anyway
        rows = batch.orderBy("cid").limit(size).collect()
        if not rows:
            break
        tried = randoms.sparkSession.createDataFrame(rows, "cid long, x double, y double, z double")
        n = _near(tried, randoms, grid, rmax, len(rows)).groupBy("cid").count().where(F.col("count") > threshold)
        dense = {r.cid for r in n.select("cid").collect()} if threshold >= 0 else {r.cid for r in rows}
        found += [r for r in rows if r.cid in dense]
        last = rows[-1].cid
        if len(rows) < size:
            break
        share = max(len(dense) / len(rows), 0.1)
        size = min(8 * nspheres, max(nspheres // 4, int((nspheres - len(found)) / share) + 1))
    return randoms.sparkSession.createDataFrame(found[:nspheres], "cid long, x double, y double, z double")


def expected_threshold(n_random: int, rmax: float, volume: float) -> int:
    """One standard deviation under the mean number of randoms in a sphere."""
    mean = n_random * 4.0 / 3.0 * math.pi * rmax**3 / volume
    return int(mean - math.sqrt(mean))


def vpf_mocks(points: DataFrame, randoms: DataFrame, rmax: float, nbins: int, nspheres: int, numpN: int, threshold_ngb: int, cosmology: int, *, is_comoving_dist: bool = False, centers: DataFrame | str | None = None, max_cells_per_dim: int = MAX_CELLS) -> DataFrame:
    """``rmax, pN`` on the sky; spheres stand where the randoms are dense enough, and their number is the denominator.

    ``centers``: candidates as rows, or a path: spheres of a file that has enough
    are used without a test, and accepted ones are written there otherwise.
    """
    _checked(rmax, nbins, nspheres, numpN)
    data, random = (cartesian(p, cosmology, is_comoving_dist, fix=False) for p in (points, randoms))
    given = _given(points.sparkSession, centers, rmax, nspheres)
    if isinstance(centers, str) and given is not None:
        chosen = given.select("cid", "x", "y", "z").orderBy("cid").limit(nspheres)
    else:
        chosen = accepted_centers(random, rmax, nspheres, threshold_ngb, given, max_cells_per_dim)
        if isinstance(centers, str):
            write_centers(chosen, centers, rmax)
    total = chosen.count()
    extent = Extent.of(data) | Extent.of(random)
    grid = Grid.plan(extent, (rmax,) * 3, (None,) * 3, max_cells_per_dim)
    return _probabilities(chosen, _near(chosen, data, grid, rmax, nspheres), rmax, nbins, numpN, total)

"""Binned pair counts: the engine behind every correlation function."""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyfield.functions.weights import weight_function
from tallyfield.plans.kernel import Metric, Reach, Task, counted
from tallyfield.plans.points import Extent
from tallyfield.plans.tiles import BROADCAST, MET, ROUND, ROUND_TILES, TASK_ROWS, Box, Tiling, chunk_size, groups, hot_tiles, packed_groups, wrap_lengths


@dataclass(frozen=True)
class Counts:
    """Sums by bin, not dense yet, with the extents of the sets for normalisation."""

    table: DataFrame
    first: Extent
    second: Extent


@dataclass(frozen=True)
class Lattice:
    """How cells are made: their number in the reach on each axis, their number on an axis at most, and whether far ones are left out."""

    bin_refine_factors: tuple[int, int, int] = (2, 2, 1)
    max_cells_per_dim: int | None = None
    enable_min_sep_opt: bool = True

    def __post_init__(self):
        if len(self.bin_refine_factors) != 3 or any(int(f) != f or f < 1 for f in self.bin_refine_factors):
            raise ValueError("three refine factors of at least 1 are needed")
        if self.max_cells_per_dim is not None and self.max_cells_per_dim < 1:
            raise ValueError("there must be one cell at least")


def lattice(xbin_refine_factor: int = 2, ybin_refine_factor: int = 2, zbin_refine_factor: int = 1, max_cells_per_dim: int | None = None, enable_min_sep_opt: bool = True) -> Lattice:
    """Options of the counters that change their speed and not their results."""
    return Lattice((xbin_refine_factor, ybin_refine_factor, zbin_refine_factor), max_cells_per_dim, enable_min_sep_opt)


@contextlib.contextmanager
def without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """A query made and run within leaves no shuffle files behind."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def rounds(tiling: Tiling, first: Extent, second: Extent | None, columns: int, ball: bool, cores: int) -> list[Box]:
    """Boxes of tiles, one where reading the points again would cost much beside their pairs."""
    n = first.n + (second.n if second else 0)
    size = 8 * columns * (first.n * (1 + tiling.copies() / 2) if second is None else first.n + second.n * (1 + tiling.copies()))
    x, y, z = tiling.reach
    reached = x * y * z * (4 / 3 if ball else 2) * math.pi
    density = (second or first).n / math.prod(s * k for s, k in zip(tiling.size, tiling.n))
    # met by a point of either set, on average
    met = density * reached * first.n / n
    return tiling.boxes(math.ceil(size / ROUND), int(min(met / MET, math.prod(tiling.n) / (ROUND_TILES * cores))))


def count_pairs(a: DataFrame, b: DataFrame | None, reach: tuple[float, float, float], metric: Metric, shape: tuple[int, ...], *, ball: bool = True, periodic: bool = False, boxsize=None, weight_type=None, average: bool = False, domain=None, coordinates: bool = False, cells: Lattice = Lattice(), self_pairs: bool = False) -> Counts:
    """``bin0, bin1, npairs, sum_sep, sum_w``; ``shape`` is the number of either kind of bins.

    One set's pairs count in both orders; with ``self_pairs`` each point counts
    with itself in the first bin.  Two sets' pairs count once each.  Sums that
    aren't asked for are zero.  Points are read once for their extent, once for
    the points of tiles where there are many, and once for the pairs of each round.
    Pairs are counted at once, and no shuffle files of them stay.
    """
    spark = a.sparkSession
    with without_shuffle_files(spark):
        first = Extent.of(a)
        second = first if b is None else Extent.of(b)
    both = first if b is None else first | second
    weigh = weight_function(weight_type)
    inner = shape[1] if len(shape) > 1 else 1
    if not first.n or not second.n:
        return Counts(spark.createDataFrame([], "bin0 int, bin1 int, npairs long, sum_sep double, sum_w double"), first, second)
    if domain:
        for lo, hi in zip(both.low, both.high):
            if lo < 0 or hi > domain:
                raise ValueError("a point is outside the box")
    wrap = wrap_lengths(both, boxsize, periodic)
    cores = spark.sparkContext.defaultParallelism
    tiling = Tiling.plan(both, reach, wrap, 8 * cores)
    sets = [a] if b is None else [a, b]
    # several weights of a point go to functions of the user alone
    arrays = callable(weight_type) and all("ws" in s.columns for s in sets)
    columns = ["x", "y", "z"] + ([] if not weigh else ["ws"] if arrays else ["w"])
    n = first.n if b is None else first.n + second.n
    partitions = max(2 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS))
    chunk = chunk_size(n, cores)
    packed = not arrays and 27 * n / chunk <= BROADCAST
    task = Task(tiling, Reach(ball, cells.bin_refine_factors, cells.max_cells_per_dim, cells.enable_min_sep_opt), metric, shape[0] * inner, coordinates, average, weigh, arrays, b is None, self_pairs and b is None)
    boxes = rounds(tiling, first, None if b is None else second, len(columns), ball, cores)
    with without_shuffle_files(spark):
        hot = hot_tiles(tiling, a, b, n, chunk) if packed else None
    sums: dict[int, tuple] = {}
    for box in boxes:
        only = box if len(boxes) > 1 else None
        with without_shuffle_files(spark):
            dealt = packed_groups(tiling, a, b, columns, n, partitions, chunk, hot, only) if packed else groups(tiling, a, b, columns, n, partitions, chunk, only)
            found = dealt.mapInArrow(counted(task, packed), "bin int, npairs long, sum_sep double, sum_w double")
            for k, *v in found.groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("npairs", "sum_sep", "sum_w")]).collect():
                sums[k] = tuple(map(sum, zip(sums[k], v))) if k in sums else tuple(v)
    rows = [(*divmod(k, inner), *v) for k, v in sorted(sums.items())]
    return Counts(spark.createDataFrame(rows, "bin0 int, bin1 int, npairs long, sum_sep double, sum_w double"), first, second)


def dense(counts: DataFrame, edges: list[float], names: tuple[str, str, str], weights: bool, inner: tuple[str, list[float]] | None = None) -> DataFrame:
    """Every bin in order of its edges: ``lo, hi, average, [inner,] npairs, weightavg``; empty ones hold zeros."""
    spark = counts.sparkSession
    lo, hi, mean = names
    rows = ", ".join(f"({i}, {j}, {edges[i]!r}D, {edges[i + 1]!r}D, {upper!r}D)" for i in range(len(edges) - 1) for j, upper in enumerate(inner[1] if inner else [0.0]))
    grid = spark.sql(f"SELECT * FROM VALUES {rows} AS g(bin0, bin1, {lo}, {hi}, upper)")
    # no more rows than the grid has
    joined = grid.join(F.broadcast(counts), ["bin0", "bin1"], "left")
    average = "if(npairs > 0, {} / npairs, 0D) AS {}"
    upper = [f"upper AS {inner[0]}"] if inner else []
    out = joined.selectExpr("bin0", "bin1", lo, hi, average.format("sum_sep", mean), *upper, "coalesce(npairs, 0L) AS npairs", average.format("sum_w", "weightavg") if weights else "0D AS weightavg")
    return out.coalesce(1).sortWithinPartitions("bin0", "bin1").drop("bin0", "bin1")

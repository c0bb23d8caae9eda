"""Command line: ``python -m tallyfield.cli STATISTIC ...`` counts catalogues and prints rows.

``--log-upper`` prints the upper edge's decimal logarithm.  The same file given
twice is one set.  Sky catalogues have columns ra, dec, cz [, w].
"""

from __future__ import annotations

import argparse
import math
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyfield.functions.bins import logbins
from tallyfield.operators import cells, estimators, mocks, theory
from tallyfield.sources.catalogs import read_catalog

#: Statistic: whether on the sky.
STATISTICS = {"DD": False, "DDrppi": False, "DDsmu": False, "wp": False, "xi": False, "vpf": False, "wprp": False, "DDrppi_mocks": True, "DDsmu_mocks": True, "DDtheta_mocks": True, "vpf_mocks": True, "wprp_mocks": True, "wtheta": True}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyfield")
    sub = p.add_subparsers(dest="statistic", required=True)
    for name in STATISTICS:
        q = sub.add_parser(name)
        q.add_argument("file1")
        q.add_argument("file2", nargs="?", help="a second set; random points for the estimators and vpf_mocks")
        q.add_argument("--format1")
        q.add_argument("--format2")
        q.add_argument("--weights", action="store_true", help="weigh pairs by the product of the fourth columns")
        q.add_argument("--average", action="store_true", help="mean separation in each bin")
        q.add_argument("--log-upper", action="store_true")
        if not name.startswith("vpf"):
            q.add_argument("--bins", required=True, help="file of lower and upper edges")
        if not STATISTICS[name]:
            q.add_argument("--boxsize", type=float, required=name in ("wp", "xi"), help="length of the box; without one the sides are open")
        if "pi" in name or name.startswith("wp"):
            q.add_argument("--pimax", type=float, required=True)
        if "smu" in name:
            q.add_argument("--mu-max", type=float, default=1.0)
            q.add_argument("--mu-bins", type=int, default=10)
        if STATISTICS[name] and "theta" not in name:
            q.add_argument("--cosmology", type=int, default=1)
            q.add_argument("--comoving", action="store_true", help="the third column is a comoving distance")
        if name.startswith("vpf"):
            for option, kind, default in (("--rmax", float, 10.0), ("--radii", int, 10), ("--spheres", int, 10_000), ("--counts", int, 6), ("--seed", int, 42)):
                q.add_argument(option, type=kind, default=default)
        if name == "vpf_mocks":
            q.add_argument("--volume", type=float, required=True, help="of the survey, for the least number of randoms in a sphere")
    q = sub.add_parser("logbins")
    q.add_argument("low", type=float)
    q.add_argument("high", type=float)
    q.add_argument("n", type=int)
    return p


def _read(spark: SparkSession, path: str | None, kind: str | None, sky: bool) -> DataFrame | None:
    if path is None:
        return None
    points = read_catalog(spark, path, kind).withColumn("w", F.coalesce("w", F.lit(1.0)))
    return points.select("id", F.col("x").alias("ra"), F.col("y").alias("dec"), F.col("z").alias("cz"), "w") if sky else points


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    name, sky = a.statistic, STATISTICS[a.statistic]
    first = _read(spark, a.file1, a.format1, sky)
    second = _read(spark, a.file2 if a.file2 != a.file1 else None, a.format2, sky)
    kind = "pair_product" if a.weights else None
    box = {} if sky else {"periodic": a.boxsize is not None, "boxsize": a.boxsize}
    if name == "DD":
        return theory.DD(first, a.bins, second, weight_type=kind, output_ravg=a.average, **box)
    if name == "DDrppi":
        return theory.DDrppi(first, a.pimax, a.bins, second, weight_type=kind, output_rpavg=a.average, **box)
    if name == "DDsmu":
        return theory.DDsmu(first, a.bins, a.mu_max, a.mu_bins, second, weight_type=kind, output_savg=a.average, **box)
    if name == "wp":
        return theory.wp(first, a.boxsize, a.pimax, a.bins, weight_type=kind, output_rpavg=a.average)
    if name == "xi":
        return theory.xi(first, a.boxsize, a.bins, weight_type=kind, output_ravg=a.average)
    if name == "vpf":
        return cells.vpf(first, a.rmax, a.radii, a.spheres, a.counts, a.seed, **box)
    if name == "DDrppi_mocks":
        return mocks.DDrppi_mocks(first, a.cosmology, a.pimax, a.bins, second, is_comoving_dist=a.comoving, weight_type=kind, output_rpavg=a.average)
    if name == "DDsmu_mocks":
        return mocks.DDsmu_mocks(first, a.cosmology, a.mu_max, a.mu_bins, a.bins, second, is_comoving_dist=a.comoving, weight_type=kind, output_savg=a.average)
    if name == "DDtheta_mocks":
        return mocks.DDtheta_mocks(first, a.bins, second, weight_type=kind, output_thetaavg=a.average)
    if second is None:
        raise SystemExit(f"{name} needs a second file, of random points")
    nd, nr = first.count(), second.count()
    if name == "vpf_mocks":
        return cells.vpf_mocks(first, second, a.rmax, a.radii, a.spheres, a.counts, cells.expected_threshold(nr, a.rmax, a.volume), a.cosmology, is_comoving_dist=a.comoving)
    if name == "wtheta":
        count = lambda x, y: mocks.DDtheta_mocks(x, a.bins, y)
        dr = count(first, second)
        return estimators.wtheta(nd, nd, nr, nr, count(first, None), dr, dr, count(second, None))
    if sky:
        count = lambda x, y: mocks.DDrppi_mocks(x, a.cosmology, a.pimax, a.bins, y, is_comoving_dist=a.comoving, output_rpavg=True)
    else:
        count = lambda x, y: theory.DDrppi(x, a.pimax, a.bins, y, output_rpavg=True, **box)
    dr = count(first, second)
    return estimators.wprp(nd, nd, nr, nr, count(first, None), dr, dr, count(second, None), a.pimax, all_bins=sky)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.statistic == "logbins":
        edges = logbins(a.low, a.high, a.n)
        print("\n".join(f"{x:.10g} {y:.10g}" for x, y in zip(edges, edges[1:])))
        return 0
    table = run(spark or SparkSession.builder.appName("tallyfield").getOrCreate(), a)
    for row in table.collect():  # as many rows as there are bins
        cells_ = [math.log10(v) if a.log_upper and n in ("rmax", "smax", "thetamax") else v for n, v in row.asDict().items()]
        print("\t".join(" ".join(map(str, v)) if isinstance(v, list) else str(v) for v in cells_))
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Registered queries over the driver's tables, each with SQL for the same rows.

The tables have no coordinates, so points are made from integer keys by the same
expressions in Spark and in SQL.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyfield.functions.bins import logbins
from tallyfield.functions.sky import fix_cz, fix_ra_dec, with_distance
from tallyfield.operators import cells, estimators, mocks, sphere, theory
from tallyfield.sources import catalogs
from tallyfield.sources.catalogs import shared_folder

BOX = 100.0
EDGES = [0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0]
RP = [0.25, 0.5, 1.0, 2.0, 3.0]
PIMAX = 4.0
THETA = [0.1, 0.25, 0.5, 1.0, 2.0]

#: id, x, y, z, w in a box of 100, from ``orders``; a smaller set from ``customer``; an unclustered one from ``supplier`` and ``part``.
POINTS = {
    "orders": """SELECT o_orderkey AS id,
        ((o_orderkey * 7919 + o_custkey * 104729) % 100003) * (100.0e0 / 100003e0) AS x,
        ((o_orderkey * 15485863 + 17) % 100019) * (100.0e0 / 100019e0) AS y,
        ((o_custkey * 32452843 + o_orderkey * 31) % 100043) * (100.0e0 / 100043e0) AS z,
        5e-1 + (o_custkey % 7) * 25e-2 AS w FROM orders""",
    "customer": """SELECT c_custkey AS id,
        ((c_custkey * 7919 + 13) % 10007) * (100.0e0 / 10007e0) AS x,
        ((c_custkey * 104729 + 29) % 10009) * (100.0e0 / 10009e0) AS y,
        ((c_custkey * 15485863 + 31) % 10037) * (100.0e0 / 10037e0) AS z,
        1e0 AS w FROM customer""",
    "part": """SELECT p_partkey AS id,
        ((p_partkey * 32452843 + 7) % 20011) * (100.0e0 / 20011e0) AS x,
        ((p_partkey * 49979687 + 11) % 20021) * (100.0e0 / 20021e0) AS y,
        ((p_partkey * 67867967 + 3) % 20023) * (100.0e0 / 20023e0) AS z,
        1e0 AS w FROM part""",
}
#: The same on the sky: right ascension, declination, comoving distance.
SKY = "SELECT id, x * 36e-1 AS ra, y * 12e-1 - 6e1 AS dec, 1e2 + z * 2e0 AS cz, w FROM ({}) AS s"


def _view(spark: SparkSession, sf_dir: str, table: str, sky: bool = False) -> DataFrame:
    # the expressions are read with the table in a view of its own name
    name = f"tallyfield_{table}"
    spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(name)
    sql = POINTS[table].replace(f"FROM {table}", f"FROM {name}")
    return spark.sql(SKY.format(sql) if sky else sql)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


def dd_auto_periodic(spark, sf_dir):
    return _rounded(theory.DD(_view(spark, sf_dir, "orders"), EDGES, boxsize=BOX, output_ravg=True), "ravg")


def dd_auto_open(spark, sf_dir):
    return theory.DD(_view(spark, sf_dir, "orders"), EDGES, periodic=False)


def dd_self_pairs(spark, sf_dir):
    return theory.DD(_view(spark, sf_dir, "orders"), [0.0, 1.0, 2.0], boxsize=BOX)


def dd_cross_periodic(spark, sf_dir):
    return theory.DD(_view(spark, sf_dir, "orders"), EDGES, _view(spark, sf_dir, "customer"), boxsize=BOX)


def dd_weighted(spark, sf_dir):
    return _rounded(theory.DD(_view(spark, sf_dir, "orders"), EDGES, boxsize=BOX, weight_type="pair_product"), "weightavg")


def ddrppi_auto(spark, sf_dir):
    return theory.DDrppi(_view(spark, sf_dir, "orders"), PIMAX, RP, boxsize=BOX)


def ddrppi_cross(spark, sf_dir):
    return theory.DDrppi(_view(spark, sf_dir, "orders"), PIMAX, RP, _view(spark, sf_dir, "part"), boxsize=BOX)


def ddsmu_auto(spark, sf_dir):
    return theory.DDsmu(_view(spark, sf_dir, "orders"), RP, 0.9, 9, boxsize=BOX)


def dd_mixed_box(spark, sf_dir):
    return theory.DD(_view(spark, sf_dir, "orders"), EDGES, boxsize=(BOX, 0, -1))


def dd_refined(spark, sf_dir):
    return theory.DD(_view(spark, sf_dir, "orders"), EDGES, boxsize=BOX, xbin_refine_factor=3, ybin_refine_factor=1, zbin_refine_factor=2, max_cells_per_dim=20, enable_min_sep_opt=False)


def ddrppi_weighted(spark, sf_dir):
    return _rounded(theory.DDrppi(_view(spark, sf_dir, "orders"), PIMAX, RP, boxsize=BOX, weight_type="pair_product", output_rpavg=True), "rpavg", "weightavg")


def ddsmu_weighted(spark, sf_dir):
    return _rounded(theory.DDsmu(_view(spark, sf_dir, "orders"), RP, 0.9, 9, boxsize=BOX, weight_type="pair_product", output_savg=True), "savg", "weightavg")


def ddsmu_cross(spark, sf_dir):
    return theory.DDsmu(_view(spark, sf_dir, "orders"), RP, 0.9, 9, _view(spark, sf_dir, "part"), boxsize=BOX)


def xi_weighted(spark, sf_dir):
    return _rounded(theory.xi(_view(spark, sf_dir, "orders"), BOX, EDGES, weight_type="pair_product", output_ravg=True), "ravg", "xi", "weightavg")


def wp_weighted(spark, sf_dir):
    return _rounded(theory.wp(_view(spark, sf_dir, "orders"), BOX, PIMAX, RP, weight_type="pair_product", output_rpavg=True), "rpavg", "wp", "weightavg")


def xi_box(spark, sf_dir):
    return _rounded(theory.xi(_view(spark, sf_dir, "orders"), BOX, EDGES), "xi")


def wp_box(spark, sf_dir):
    return _rounded(theory.wp(_view(spark, sf_dir, "orders"), BOX, PIMAX, RP), "wp")


def ddrppi_mocks(spark, sf_dir):
    return mocks.DDrppi_mocks(_view(spark, sf_dir, "orders", True), 1, PIMAX, [0.5, 1.0, 2.0, 4.0], is_comoving_dist=True)


def ddsmu_mocks(spark, sf_dir):
    return mocks.DDsmu_mocks(_view(spark, sf_dir, "orders", True), 1, 0.9, 9, [1.0, 2.0, 4.0, 6.0], is_comoving_dist=True)


def ddtheta_mocks(spark, sf_dir):
    return mocks.DDtheta_mocks(_view(spark, sf_dir, "orders", True), THETA)


def ddtheta_cross(spark, sf_dir):
    return mocks.DDtheta_mocks(_view(spark, sf_dir, "orders", True), THETA, _view(spark, sf_dir, "part", True))


RP_SKY, S_SKY = [0.5, 1.0, 2.0, 4.0], [1.0, 2.0, 4.0, 6.0]


def ddrppi_mocks_weighted(spark, sf_dir):
    return _rounded(mocks.DDrppi_mocks(_view(spark, sf_dir, "orders", True), 1, PIMAX, RP_SKY, is_comoving_dist=True, weight_type="pair_product", output_rpavg=True), "rpavg", "weightavg")


def ddrppi_mocks_cross(spark, sf_dir):
    return mocks.DDrppi_mocks(_view(spark, sf_dir, "orders", True), 1, PIMAX, RP_SKY, _view(spark, sf_dir, "part", True), is_comoving_dist=True)


def ddsmu_mocks_weighted(spark, sf_dir):
    return _rounded(mocks.DDsmu_mocks(_view(spark, sf_dir, "orders", True), 1, 0.9, 9, S_SKY, is_comoving_dist=True, weight_type="pair_product", output_savg=True), "savg", "weightavg")


def ddsmu_mocks_cross(spark, sf_dir):
    return mocks.DDsmu_mocks(_view(spark, sf_dir, "orders", True), 1, 0.9, 9, S_SKY, _view(spark, sf_dir, "part", True), is_comoving_dist=True)


def ddtheta_weighted(spark, sf_dir):
    return _rounded(mocks.DDtheta_mocks(_view(spark, sf_dir, "orders", True), THETA, weight_type="pair_product", output_thetaavg=True), "thetaavg", "weightavg")


#: Redshifts instead of distances, and angles that need mending: ascension from -180, declination from 30 to 150.
def ddrppi_mocks_cosmology(spark, sf_dir):
    points = _view(spark, sf_dir, "customer", True).select("id", (F.col("ra") - 180.0).alias("ra"), (F.col("dec") + 90.0).alias("dec"), ((F.col("cz") - 100.0) / 1000.0).alias("cz"), "w")
    return mocks.DDrppi_mocks(points, 2, 40.0, [5.0, 20.0, 40.0])


def mended_sky(spark, sf_dir):
    points = _view(spark, sf_dir, "customer", True).select("id", (F.col("ra") - 180.0).alias("ra"), (F.col("dec") + 90.0).alias("dec"), ((F.col("cz") - 100.0) / 1000.0).alias("cz"))
    return _rounded(fix_cz(fix_ra_dec(points)), "ra", "dec", "cz")


def brute_force_theta(spark, sf_dir):
    return mocks.DDtheta_brute_force(_view(spark, sf_dir, "customer", True), [1.0, 5.0, 20.0, 90.0])


def _spheres(spark, sf_dir):
    return _view(spark, sf_dir, "customer").select(F.col("id").alias("cid"), "x", "y", "z")


def _spread(df: DataFrame, n: int) -> DataFrame:
    return df.select(F.round("rmax", 6).alias("rmax"), *[F.round(F.col("pN")[i], 9).alias(f"p{i}") for i in range(n)])


def vpf_box(spark, sf_dir):
    return _spread(cells.vpf(_view(spark, sf_dir, "orders"), 5.0, 5, 1000, 4, 42, boxsize=BOX, centers=_spheres(spark, sf_dir)), 4)


def vpf_sky(spark, sf_dir):
    data, randoms = _view(spark, sf_dir, "customer", True), _view(spark, sf_dir, "part", True)
    return _spread(cells.vpf_mocks(data, randoms, 30.0, 5, 500, 4, 2, 1, is_comoving_dist=True), 4)


def vpf_random(spark, sf_dir):
    return _spread(cells.vpf(_view(spark, sf_dir, "orders"), 5.0, 5, 300, 4, 42, boxsize=BOX), 4)


def catalog_round_trip(spark, sf_dir):
    folder = f"{shared_folder(spark)}/catalogue-{uuid.uuid4().hex}"
    catalogs.write_ascii_catalog(_view(spark, sf_dir, "customer"), folder)
    return catalogs.read_catalog(spark, folder, "a").select("x", "y", "z", "w")


def record_round_trip(spark, sf_dir):
    path = f"{shared_folder(spark)}/points-{uuid.uuid4().hex}.ff"
    catalogs.write_fastfood_catalog(_view(spark, sf_dir, "customer"), path)
    return catalogs.read_catalog(spark, path).select("x", "y", "z", "w")


def _four(spark, sf_dir):
    d, r = _view(spark, sf_dir, "orders"), _view(spark, sf_dir, "part")
    return d, r, d.count(), r.count()


def landy_szalay(spark, sf_dir):
    d, r, nd, nr = _four(spark, sf_dir)
    dd, dr, rr = theory.DD(d, EDGES, boxsize=BOX), theory.DD(d, EDGES, r, boxsize=BOX), theory.DD(r, EDGES, boxsize=BOX)
    out = estimators.convert_3d_counts_to_cf(nd, nd, nr, nr, dd, dr, dr, rr)
    return out.select("rmin", "rmax", F.round(F.when(~F.isnan("cf"), F.col("cf")), 6).alias("cf"))


def landy_szalay_wp(spark, sf_dir):
    d, r, nd, nr = _four(spark, sf_dir)
    bins = [2.0, 3.0, 4.0]
    dd, dr, rr = (theory.DDrppi(a, PIMAX, bins, b, boxsize=BOX) for a, b in ((d, None), (d, r), (r, None)))
    out = estimators.convert_rp_pi_counts_to_wp(nd, nd, nr, nr, dd, dr, dr, rr, 2, PIMAX)
    return out.select("rmin", "rmax", F.round(F.when(~F.isnan("wp"), F.col("wp")), 6).alias("wp"))


def wprp_box(spark, sf_dir):
    d, r, nd, nr = _four(spark, sf_dir)
    dd, dr, rr = (theory.DDrppi(a, PIMAX, [2.0, 3.0, 4.0], b, boxsize=BOX, output_rpavg=True) for a, b in ((d, None), (d, r), (r, None)))
    out = estimators.wprp(nd, nd, nr, nr, dd, dr, dr, rr, 2.0)
    return out.select("rmin", "rmax", F.round("rpavg", 6).alias("rpavg"), F.round(F.when(~F.isnan("wp"), F.col("wp")), 6).alias("wp"))


def wprp_mocks(spark, sf_dir):
    d, r = _view(spark, sf_dir, "orders", True), _view(spark, sf_dir, "part", True)
    nd, nr = d.count(), r.count()
    dd, dr, rr = (mocks.DDrppi_mocks(a, 1, PIMAX, [4.0, 6.0, 8.0], b, is_comoving_dist=True, output_rpavg=True) for a, b in ((d, None), (d, r), (r, None)))
    out = estimators.wprp(nd, nd, nr, nr, dd, dr, dr, rr, PIMAX, all_bins=True)
    return out.select("rmin", "rmax", F.round("rpavg", 6).alias("rpavg"), F.round(F.when(~F.isnan("wp"), F.col("wp")), 6).alias("wp"))


def landy_szalay_theta(spark, sf_dir):
    d, r = _view(spark, sf_dir, "orders", True), _view(spark, sf_dir, "part", True)
    nd, nr = d.count(), r.count()
    dd, dr, rr = mocks.DDtheta_mocks(d, THETA), mocks.DDtheta_mocks(d, THETA, r), mocks.DDtheta_mocks(r, THETA)
    out = estimators.wtheta(nd, nd, nr, nr, dd, dr, dr, rr)
    return out.select("thetamin", "thetamax", F.round(F.when(~F.isnan("wtheta"), F.col("wtheta")), 6).alias("wtheta"))


def comoving_distance(spark, sf_dir):
    z = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") % 1000) / 1000.0 * 299800.0).alias("cz"))
    return with_distance(z, 1).select("id", F.round("dist", 3).alias("dist"))


def sky_lattice(spark, sf_dir):
    return _rounded(sphere.gridlink_sphere(spark, 30.0), "dec_min", "dec_max", "ra_min", "ra_max")


def log_bins(spark, sf_dir):
    edges = logbins(0.1, 25.0, 14)
    return spark.createDataFrame([(i, round(a, 9), round(b, 9)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, lo double, hi double")


QUERIES = {f.__name__: f for f in (dd_auto_periodic, dd_auto_open, dd_self_pairs, dd_cross_periodic, dd_weighted, ddrppi_auto, ddrppi_cross, ddsmu_auto, xi_box, wp_box, ddrppi_mocks, ddsmu_mocks, ddtheta_mocks, ddtheta_cross, dd_mixed_box, dd_refined, ddrppi_weighted, ddsmu_weighted, ddsmu_cross, xi_weighted, wp_weighted, ddrppi_mocks_weighted, ddrppi_mocks_cross, ddsmu_mocks_weighted, ddsmu_mocks_cross, ddtheta_weighted, ddrppi_mocks_cosmology, mended_sky, brute_force_theta, vpf_box, vpf_sky, vpf_random, catalog_round_trip, record_round_trip, wprp_box, wprp_mocks, landy_szalay, landy_szalay_wp, landy_szalay_theta, comoving_distance, sky_lattice, log_bins)}


# SQL -------------------------------------------------------------------------


def _edges_sql(edges, lo: str = "rmin", hi: str = "rmax") -> str:
    rows = ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(zip(edges, edges[1:])))
    return f"(VALUES {rows}) AS e(bin, {lo}, {hi})"


def _bin_sql(value: str, inner) -> str:
    return " + ".join([f"({value} >= {e!r}::DOUBLE)::INT" for e in inner]) or "0"


def _axis_sql(v: str, length: str | None) -> str:
    d = f"abs(a.{v} - b.{v})"
    return f"CASE WHEN {d} >= {length} / 2 THEN {length} - {d} ELSE {d} END" if length else d


def _pairs_sql(a: str, b: str | None, reach: float, wrap: bool = True, reach_z: float | None = None, lengths: tuple | None = None) -> str:
    """Ordered pairs with dx, dy, dz and both weights."""
    lengths = lengths or ((f"{BOX!r}::DOUBLE",) * 3 if wrap else (None,) * 3)
    axes = ", ".join(f"{_axis_sql(v, length)} AS d{v}" for v, length in zip("xyz", lengths))
    first = f"WITH a AS MATERIALIZED ({POINTS[a]}), b AS MATERIALIZED ({POINTS[b or a]})"
    return f"{first}, pairs AS (SELECT * FROM (SELECT {axes}, a.w AS wa, b.w AS wb FROM a, b WHERE {'a.id <> b.id' if b is None else 'true'}) WHERE dx < {reach} AND dy < {reach} AND dz < {reach_z or reach})"


def _mean_sql(column: str, wanted: bool) -> str:
    return f"round(coalesce({column} / n, 0), 6)" if wanted else "0e0"


def _dd_sql(a: str, b: str | None, edges=EDGES, wrap: bool = True, ravg: bool = False, weights: bool = False, own: bool = False, lengths: tuple | None = None) -> str:
    sq = [e * e for e in edges]
    r2 = "dx * dx + dy * dy + dz * dz"
    self_pairs = f" + CASE WHEN e.bin = 0 THEN (SELECT count(*) FROM ({POINTS[a]})) ELSE 0 END" if own else ""
    return f"""{_pairs_sql(a, b, edges[-1], wrap, lengths=lengths)},
        c AS (SELECT {_bin_sql('r2', sq[1:-1])} AS bin, count(*) AS n, sum(sqrt(r2)) AS s, sum(wa * wb) AS sw FROM (SELECT {r2} AS r2, wa, wb FROM pairs) WHERE r2 >= {sq[0]!r}::DOUBLE AND r2 < {sq[-1]!r}::DOUBLE GROUP BY 1)
        SELECT rmin, rmax, {_mean_sql('s', ravg)}::DOUBLE AS ravg, (coalesce(n, 0){self_pairs})::BIGINT AS npairs, {_mean_sql('sw', weights)}::DOUBLE AS weightavg FROM {_edges_sql(edges)} LEFT JOIN c USING (bin)"""


def _grid_sql(counts: str, edges, inner: int, step: float, names: tuple[str, str, str, str], mean: bool = False) -> str:
    """``counts`` has bin, j, n, and s and sw where means are wanted."""
    lo, hi, average, upper = names
    return f"""SELECT {lo}, {hi}, {_mean_sql('s', mean)}::DOUBLE AS {average}, (j.j + 1) * {step!r}::DOUBLE AS {upper}, coalesce(n, 0)::BIGINT AS npairs, {_mean_sql('sw', mean)}::DOUBLE AS weightavg
        FROM {_edges_sql(edges, lo, hi)} CROSS JOIN (SELECT unnest(range({inner})) AS j) AS j LEFT JOIN ({counts}) AS c ON c.bin = e.bin AND c.j = j.j"""


def _rppi_counts(edges) -> str:
    sq = [e * e for e in edges]
    return f"SELECT {_bin_sql('r2', sq[1:-1])} AS bin, floor(dz)::INT AS j, count(*) AS n, sum(sqrt(r2)) AS s, sum(wa * wb) AS sw FROM (SELECT dx * dx + dy * dy AS r2, dz, wa, wb FROM pairs) WHERE dz < {PIMAX} AND r2 >= {sq[0]!r}::DOUBLE AND r2 < {sq[-1]!r}::DOUBLE GROUP BY 1, 2"


def _ddrppi_sql(a: str, b: str | None, edges=RP, mean: bool = False) -> str:
    return f"{_pairs_sql(a, b, edges[-1], reach_z=PIMAX)} {_grid_sql(_rppi_counts(edges), edges, 4, 1.0, ('rmin', 'rmax', 'rpavg', 'pimax'), mean)}"


def _ddsmu_sql(b: str | None = None, mean: bool = False) -> str:
    sq = [e * e for e in RP]
    counts = f"""SELECT {_bin_sql('s2', sq[1:-1])} AS bin, floor(sqrt(dz * dz / s2) * {1.0 / (0.9 / 9)!r}::DOUBLE)::INT AS j, count(*) AS n, sum(sqrt(s2)) AS s, sum(wa * wb) AS sw
        FROM (SELECT dx * dx + dy * dy + dz * dz AS s2, dz, wa, wb FROM pairs) WHERE s2 >= {sq[0]!r}::DOUBLE AND s2 < {sq[-1]!r}::DOUBLE AND dz * dz < s2 * {0.9 * 0.9!r}::DOUBLE GROUP BY 1, 2"""
    return f"{_pairs_sql('orders', b, RP[-1])} {_grid_sql(counts, RP, 9, 0.9 / 9, ('smin', 'smax', 'savg', 'mu_max'), mean)}"


def _density_sql(weighted: bool) -> str:
    total = "sum(w)" if weighted else "count(*)::DOUBLE"
    return f"(SELECT {total} * ({total} - {total} / count(*)) / {BOX**3!r}::DOUBLE FROM ({POINTS['orders']}))"


def _xi_weighted_sql() -> str:
    volume = f"{4.0 / 3.0 * math.pi!r}::DOUBLE * (rmax * rmax * rmax - rmin * rmin * rmin)"
    exact = _dd_sql("orders", None, weights=True, ravg=True).replace("round(coalesce(sw / n, 0), 6)", "coalesce(sw / n, 0)")
    return f"SELECT rmin, rmax, ravg, round(npairs * weightavg / ({_density_sql(True)} * {volume}) - 1, 6) AS xi, npairs, round(weightavg, 6) AS weightavg FROM ({exact})"


def _wp_weighted_sql() -> str:
    volume = f"{math.pi!r}::DOUBLE * (rmax * rmax - rmin * rmin) * {2 * PIMAX}"
    exact = _ddrppi_sql("orders", None, mean=True).replace("round(coalesce(sw / n, 0), 6)", "coalesce(sw / n, 0)").replace("round(coalesce(s / n, 0), 6)", "coalesce(s / n, 0)")
    return f"""SELECT rmin, rmax, round(s / n, 6) AS rpavg, round((sw / ({_density_sql(True)} * {volume}) - 1) * {2 * PIMAX}, 6) AS wp, n AS npairs, round(sw / n, 6) AS weightavg
        FROM (SELECT rmin, rmax, sum(npairs)::BIGINT AS n, sum(npairs * rpavg) AS s, sum(npairs * weightavg) AS sw FROM ({exact}) GROUP BY rmin, rmax)"""


def _xi_sql() -> str:
    n = f"(SELECT count(*) FROM ({POINTS['orders']}))::DOUBLE"
    volume = f"{4.0 / 3.0 * math.pi!r}::DOUBLE * (rmax * rmax * rmax - rmin * rmin * rmin)"
    return f"SELECT rmin, rmax, ravg, round(npairs / ({n} * ({n} - 1) / {BOX**3!r}::DOUBLE * {volume}) - 1, 6) AS xi, npairs, weightavg FROM ({_dd_sql('orders', None)})"


def _wp_sql() -> str:
    n = f"(SELECT count(*) FROM ({POINTS['orders']}))::DOUBLE"
    volume = f"{math.pi!r}::DOUBLE * (rmax * rmax - rmin * rmin) * {2 * PIMAX}"
    return f"SELECT rmin, rmax, 0e0::DOUBLE AS rpavg, round((sum(npairs)::DOUBLE / ({n} * ({n} - 1) / {BOX**3!r}::DOUBLE * {volume}) - 1) * {2 * PIMAX}, 6) AS wp, sum(npairs)::BIGINT AS npairs, 0e0::DOUBLE AS weightavg FROM ({_ddrppi_sql('orders', None)}) GROUP BY rmin, rmax"


def _sky_points(table: str, distance: bool) -> str:
    d = "cz" if distance else "1e0"
    return f"SELECT id, w, cos(radians(dec)) * cos(radians(ra)) * {d} AS x, cos(radians(dec)) * sin(radians(ra)) * {d} AS y, sin(radians(dec)) * {d} AS z FROM ({SKY.format(POINTS[table])})"


def _sky_pairs(a: str, b: str | None, reach: float, distance: bool = True) -> str:
    return _near_pairs(_sky_points(a, distance), _sky_points(b or a, distance), b is None, reach)


def _near_pairs(a: str, b: str, same: bool, reach: float) -> str:
    near = " AND ".join(f"a.{v} - b.{v} BETWEEN -{reach!r}::DOUBLE AND {reach!r}::DOUBLE" for v in "xyz")
    return f"WITH a AS MATERIALIZED ({a}), b AS MATERIALIZED ({b}), pairs AS (SELECT a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, a.w AS wa, b.w AS wb FROM a, b WHERE {near}{' AND a.id <> b.id' if same else ''})"


_SIGHT = """SELECT (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) + (bz - az) * (bz - az) AS s2, (bx + ax) * (bx + ax) + (by_ + ay) * (by_ + ay) + (bz + az) * (bz + az) AS l2,
    (bx - ax) * (bx + ax) + (by_ - ay) * (by_ + ay) + (bz - az) * (bz + az) AS sl, wa, wb FROM pairs"""


def _rppi_sky(edges, pimax: float, bins: int, mean: bool = False) -> str:
    sq = [e * e for e in edges]
    counts = f"""SELECT {_bin_sql('rp2', sq[1:-1])} AS bin, floor(sqrt(par2) * {1.0 / (pimax / bins)!r}::DOUBLE)::INT AS j, count(*) AS n, sum(sqrt(rp2)) AS s, sum(wa * wb) AS sw FROM (SELECT *, sl * sl / l2 AS par2, s2 - sl * sl / l2 AS rp2 FROM ({_SIGHT}))
        WHERE sl * sl < l2 * {pimax * pimax} AND rp2 >= {sq[0]!r}::DOUBLE AND rp2 < {sq[-1]!r}::DOUBLE GROUP BY 1, 2"""
    return _grid_sql(counts, edges, bins, pimax / bins, ("rmin", "rmax", "rpavg", "pimax"), mean)


def _ddrppi_mocks_sql(a: str = "orders", b: str | None = None, edges=RP_SKY, mean: bool = False) -> str:
    return f"{_sky_pairs(a, b, math.hypot(edges[-1], PIMAX))} {_rppi_sky(edges, PIMAX, 4, mean)}"


def _ddsmu_mocks_sql(b: str | None = None, mean: bool = False) -> str:
    sq = [e * e for e in S_SKY]
    counts = f"""SELECT {_bin_sql('s2', sq[1:-1])} AS bin, floor(sqrt(mu2) * {1.0 / (0.9 / 9)!r}::DOUBLE)::INT AS j, count(*) AS n, sum(sqrt(s2)) AS s, sum(wa * wb) AS sw FROM (SELECT *, sl * sl / (l2 * s2) AS mu2 FROM ({_SIGHT}) WHERE s2 > 0)
        WHERE s2 >= {sq[0]!r}::DOUBLE AND s2 < {sq[-1]!r}::DOUBLE AND mu2 < {0.9 * 0.9!r}::DOUBLE GROUP BY 1, 2"""
    return f"{_sky_pairs('orders', b, S_SKY[-1])} {_grid_sql(counts, S_SKY, 9, 0.9 / 9, ('smin', 'smax', 'savg', 'mumax'), mean)}"


def _theta_sql(a: str, b: str | None, edges=THETA, mean: bool = False) -> str:
    cosines = [math.cos(math.radians(t)) for t in edges]
    inner = " + ".join(f"(c <= {v!r}::DOUBLE)::INT" for v in cosines[1:-1])
    return f"""{_sky_pairs(a, b, 2 * math.sin(math.radians(edges[-1]) / 2) * 1.001, False)},
        n AS (SELECT {inner} AS bin, count(*) AS n, sum(degrees(acos(greatest(-1e0, least(1e0, c))))) AS s, sum(wa * wb) AS sw FROM (SELECT ax * bx + ay * by_ + az * bz AS c, wa, wb FROM pairs) WHERE c > {cosines[-1]!r}::DOUBLE AND c <= {cosines[0]!r}::DOUBLE GROUP BY 1)
        SELECT thetamin, thetamax, {_mean_sql('s', mean)}::DOUBLE AS thetaavg, coalesce(n, 0)::BIGINT AS npairs, {_mean_sql('sw', mean)}::DOUBLE AS weightavg FROM {_edges_sql(edges, 'thetamin', 'thetamax')} LEFT JOIN n USING (bin)"""


def _mended_sql() -> str:
    # what was moved by half a turn and a quarter is back in place
    return f"SELECT id, round(ra, 6) AS ra, round(dec, 6) AS dec, round((cz - 100e0) / 1000e0 * 299800e0, 6) AS cz FROM ({SKY.format(POINTS['customer'])})"


def _cosmology_sql() -> str:
    return f"""WITH s AS MATERIALIZED (SELECT id, w, ra, dec, (cz - 100e0) / 1000e0 AS z FROM ({SKY.format(POINTS['customer'])})),
        d AS MATERIALIZED (SELECT id, 2998e0 * sum(z / 400 / 3 * CASE WHEN k IN (0, 400) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END / sqrt(302e-3 * pow(1 + z * k / 400, 3) + 698e-3)) AS dist FROM s, (SELECT unnest(range(401)) AS k) GROUP BY id),
        p AS MATERIALIZED (SELECT id, w, cos(radians(dec)) * cos(radians(ra)) * dist AS x, cos(radians(dec)) * sin(radians(ra)) * dist AS y, sin(radians(dec)) * dist AS z FROM s JOIN d USING (id)),
        {_near_pairs('SELECT * FROM p', 'SELECT * FROM p', True, math.hypot(40.0, 40.0)).removeprefix('WITH ')} {_rppi_sky([5.0, 20.0, 40.0], 40.0, 40)}"""


def _vpf_random_sql() -> str:
    u = np.random.RandomState(42).randint(0, 2**32, size=(300, 3), dtype=np.uint32) / 2.0**32
    rows = ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for i, (a, b, c) in enumerate(u.tolist()))
    r2 = " + ".join(f"({_axis_sql(v, f'{BOX!r}::DOUBLE')}) * ({_axis_sql(v, f'{BOX!r}::DOUBLE')})" for v in "xyz")
    low = ", ".join(f"{v} * {BOX!r}::DOUBLE + (SELECT min({v}) FROM b) AS {v}" for v in "xyz")
    return f"""WITH b AS MATERIALIZED ({POINTS['orders']}), s AS MATERIALIZED (SELECT cid, {low} FROM (VALUES {rows}) AS u(cid, x, y, z)),
        near AS (SELECT cid, floor(sqrt(r2))::INT AS bin FROM (SELECT a.cid, {r2} AS r2 FROM s AS a, b) WHERE r2 < 25), {_vpf_tail(5.0)}"""


def _wprp_sql(dd: str, dr: str, rr: str, upto: float) -> str:
    keys = "rmin, rmax, pimax"
    mean = f"SELECT rmin, rmax, round(coalesce(sum(rpavg * npairs) / nullif(sum(npairs), 0), 0), 6) AS rpavg FROM ({dd}) WHERE pimax <= {upto} GROUP BY ALL"
    wp = f"SELECT rmin, rmax, CASE WHEN count(cf) = count(*) THEN round(2 * sum(cf), 6) END AS wp FROM ({_ls_sql(dd, dr, rr, keys)}) WHERE pimax <= {upto} GROUP BY ALL"
    return f"SELECT rmin, rmax, rpavg, wp FROM ({mean}) JOIN ({wp}) USING (rmin, rmax)"


def _exact(sql: str) -> str:
    """Means without rounding, for sums over them."""
    return sql.replace("round(coalesce(s / n, 0), 6)", "coalesce(s / n, 0)")


def _vpf_tail(rmax: float) -> str:
    shares = ", ".join(f"round(count(*) FILTER (WHERE n = {i}) / (SELECT count(*) FROM s)::DOUBLE, 9) AS p{i}" for i in range(4))
    return f"""h AS (SELECT s.cid, k.k, count(near.cid) AS n FROM s CROSS JOIN (SELECT unnest(range(1, 6)) AS k) AS k LEFT JOIN near ON near.cid = s.cid AND near.bin < k.k GROUP BY 1, 2)
        SELECT round(k * {rmax / 5!r}::DOUBLE, 6) AS rmax, {shares} FROM h GROUP BY k"""


def _vpf_sql() -> str:
    r2 = " + ".join(f"({_axis_sql(v, f'{BOX!r}::DOUBLE')}) * ({_axis_sql(v, f'{BOX!r}::DOUBLE')})" for v in "xyz")
    return f"""WITH b AS MATERIALIZED ({POINTS['orders']}), s AS MATERIALIZED (SELECT id AS cid, x, y, z FROM ({POINTS['customer']}) ORDER BY id LIMIT 1000),
        near AS (SELECT cid, floor(sqrt(r2))::INT AS bin FROM (SELECT a.cid, {r2} AS r2 FROM s AS a, b) WHERE r2 < 25), {_vpf_tail(5.0)}"""


def _vpf_sky_sql() -> str:
    r2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
    return f"""WITH r AS MATERIALIZED ({_sky_points('part', True)}), b AS MATERIALIZED ({_sky_points('customer', True)}),
        s AS MATERIALIZED (SELECT a.id AS cid, a.x, a.y, a.z FROM r AS a, r AS b WHERE {r2} < 900 GROUP BY ALL HAVING count(*) > 2 ORDER BY cid LIMIT 500),
        near AS (SELECT cid, floor(sqrt(r2) * {1.0 / 6.0!r}::DOUBLE)::INT AS bin FROM (SELECT a.cid, {r2} AS r2 FROM s AS a, b) WHERE r2 < 900), {_vpf_tail(30.0)}"""


def _ls_sql(dd: str, dr: str, rr: str, keys: str) -> str:
    f = f"((SELECT count(*) FROM ({POINTS['part']}))::DOUBLE / (SELECT count(*) FROM ({POINTS['orders']})))"
    return f"SELECT {keys}, CASE WHEN rr.npairs > 0 THEN ({f} * {f} * dd.npairs - 2 * {f} * dr.npairs + rr.npairs) / rr.npairs END AS cf FROM ({dd}) AS dd JOIN ({dr}) AS dr USING ({keys}) JOIN ({rr}) AS rr USING ({keys})"


def _distance_sql() -> str:
    return """WITH s AS (SELECT s_suppkey AS id, (s_suppkey % 1000) / 1000e0 AS z FROM supplier),
        t AS (SELECT s.id, s.z, k.k, s.z / 2000 AS h, s.z * k.k / 2000 AS v FROM s, (SELECT unnest(range(2001)) AS k) AS k)
        SELECT id, round(2998e0 * sum(h / 3 * CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END / sqrt(25e-2 * (1 + v) * (1 + v) * (1 + v) + 75e-2)), 3) AS dist FROM t GROUP BY id"""


def _bins_sql() -> str:
    edge = lambda k: f"round(0.1e0 * pow(pow(25e0 / 0.1e0, 1e0 / 14), {k}), 9)"
    return f"SELECT k::INT AS bin, {edge('k')} AS lo, CASE WHEN k = 13 THEN 25e0 ELSE {edge('k + 1')} END AS hi FROM (SELECT unnest(range(14)) AS k)"


def _lattice_sql() -> str:
    t, pi = math.radians(30.0), math.pi
    lo, hi = f"(i * {pi / 6!r}::DOUBLE - {pi / 2!r}::DOUBLE)", f"((i + 1) * {pi / 6!r}::DOUBLE - {pi / 2!r}::DOUBLE)"
    n = f"greatest(1, floor({2 * pi!r}::DOUBLE / least({2 * pi!r}::DOUBLE, 2 * asin(least(1e0, {math.sin(t)!r}::DOUBLE / least(cos({lo}), cos({hi})))))))::INT"
    return f"""SELECT (row_number() OVER (ORDER BY i, j) - 1)::INT AS cell, i::INT AS dec_band, j::INT AS ra_cell, round({lo}, 6) AS dec_min, round({hi}, 6) AS dec_max, round(j * {2 * pi!r}::DOUBLE / n, 6) AS ra_min, round((j + 1) * {2 * pi!r}::DOUBLE / n, 6) AS ra_max
        FROM (SELECT i, n, unnest(range(n)) AS j FROM (SELECT i, {n} AS n FROM (SELECT unnest(range(6)) AS i)))"""


_WP_BINS, _WP_SKY = [2.0, 3.0, 4.0], [4.0, 6.0, 8.0]

ORACLE_SQL = {
    "dd_auto_periodic": _dd_sql("orders", None, ravg=True),
    "dd_auto_open": _dd_sql("orders", None, wrap=False),
    "dd_self_pairs": _dd_sql("orders", None, [0.0, 1.0, 2.0], own=True),
    "dd_cross_periodic": _dd_sql("orders", "customer"),
    "dd_weighted": _dd_sql("orders", None, weights=True),
    "ddrppi_auto": _ddrppi_sql("orders", None),
    "ddrppi_cross": _ddrppi_sql("orders", "part"),
    "ddsmu_auto": _ddsmu_sql(),
    "xi_box": _xi_sql(),
    "wp_box": _wp_sql(),
    "ddrppi_mocks": _ddrppi_mocks_sql(),
    "ddsmu_mocks": _ddsmu_mocks_sql(),
    "ddtheta_mocks": _theta_sql("orders", None),
    "ddtheta_cross": _theta_sql("orders", "part"),
    "dd_mixed_box": _dd_sql("orders", None, lengths=(f"{BOX!r}::DOUBLE", "(SELECT max(y) - min(y) FROM a)", None)),
    "dd_refined": _dd_sql("orders", None),
    "ddrppi_weighted": _ddrppi_sql("orders", None, mean=True),
    "ddsmu_weighted": _ddsmu_sql(mean=True),
    "ddsmu_cross": _ddsmu_sql("part"),
    "xi_weighted": _xi_weighted_sql(),
    "wp_weighted": _wp_weighted_sql(),
    "ddrppi_mocks_weighted": _ddrppi_mocks_sql(mean=True),
    "ddrppi_mocks_cross": _ddrppi_mocks_sql(b="part"),
    "ddsmu_mocks_weighted": _ddsmu_mocks_sql(mean=True),
    "ddsmu_mocks_cross": _ddsmu_mocks_sql("part"),
    "ddtheta_weighted": _theta_sql("orders", None, mean=True),
    "ddrppi_mocks_cosmology": _cosmology_sql(),
    "mended_sky": _mended_sql(),
    "brute_force_theta": _theta_sql("customer", None, [1.0, 5.0, 20.0, 90.0]),
    "vpf_random": _vpf_random_sql(),
    "catalog_round_trip": f"SELECT x, y, z, w FROM ({POINTS['customer']})",
    "record_round_trip": f"SELECT x, y, z, w FROM ({POINTS['customer']})",
    "wprp_box": _wprp_sql(_exact(_ddrppi_sql("orders", None, _WP_BINS, True)), _ddrppi_sql("orders", "part", _WP_BINS), _ddrppi_sql("part", None, _WP_BINS), 2.0),
    "wprp_mocks": _wprp_sql(_exact(_ddrppi_mocks_sql("orders", None, _WP_SKY, True)), _ddrppi_mocks_sql("orders", "part", _WP_SKY), _ddrppi_mocks_sql("part", None, _WP_SKY), PIMAX),
    "vpf_box": _vpf_sql(),
    "vpf_sky": _vpf_sky_sql(),
    "landy_szalay": f"SELECT rmin, rmax, round(cf, 6) AS cf FROM ({_ls_sql(_dd_sql('orders', None), _dd_sql('orders', 'part'), _dd_sql('part', None), 'rmin, rmax')})",
    "landy_szalay_wp": f"SELECT rmin, rmax, CASE WHEN count(cf) = 4 THEN round(2 * sum(cf), 6) END AS wp FROM ({_ls_sql(_ddrppi_sql('orders', None, _WP_BINS), _ddrppi_sql('orders', 'part', _WP_BINS), _ddrppi_sql('part', None, _WP_BINS), 'rmin, rmax, pimax')}) GROUP BY ALL",
    "landy_szalay_theta": f"SELECT thetamin, thetamax, round(cf, 6) AS wtheta FROM ({_ls_sql(_theta_sql('orders', None), _theta_sql('orders', 'part'), _theta_sql('part', None), 'thetamin, thetamax')})",
    "comoving_distance": _distance_sql(),
    "sky_lattice": _lattice_sql(),
    "log_bins": _bins_sql(),
}

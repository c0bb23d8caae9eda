"""Counts in cells, estimators, distances, catalogues, lattices, streaming and the entry point."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.functions import bins, sky
from tallyfield.operators import cells, estimators, sphere, theory
from tallyfield.sources import catalogs
from tallyfield.streaming.incremental import GrowingCounts


def frame(spark, p):
    return spark.createDataFrame([(i, *map(float, v), 1.0) for i, v in enumerate(p)], "id long, x double, y double, z double, w double")


@pytest.mark.parametrize("periodic", [True, False])
def test_vpf_brute_force(spark, periodic):
    p, box = np.random.RandomState(1).rand(400, 3) * 50, 50.0
    low, high = p.min(0), p.max(0)
    found = cells.vpf(frame(spark, p), 8.0, 4, 60, 5, 42, periodic=periodic, boxsize=box).collect()
    c = cells.random_centers(60, 42, low, [box] * 3 if periodic else high - low, None if periodic else 8.0)
    d = np.abs(c[:, None] - p[None])
    d = np.where(d >= box / 2, box - d, d) if periodic else d
    r = np.sqrt((d**2).sum(-1))
    for k, row in enumerate(found):
        n = (r < (k + 1) * 2.0).sum(1)
        assert row.rmax == pytest.approx((k + 1) * 2.0)
        assert row.pN == pytest.approx([(n == i).mean() for i in range(5)])


def test_centers_come_from_a_file_or_fill_it(spark, tmp_path):
    p, path = np.random.RandomState(1).rand(300, 3) * 50, str(tmp_path / "centers")
    made = [r.pN for r in cells.vpf(frame(spark, p), 8.0, 2, 40, 4, 5, boxsize=50.0, centers=path).collect()]
    assert catalogs.read_centers(spark, path, 8.0, 40).count() == 40
    assert [r.pN for r in cells.vpf(frame(spark, p), 8.0, 2, 40, 4, 99, boxsize=50.0, centers=path).collect()] == made
    # spheres that are too small aren't used
    assert [r.pN for r in cells.vpf(frame(spark, p), 9.0, 2, 40, 4, 99, boxsize=50.0, centers=path).collect()] != made
    sky_ = spark.createDataFrame([(i, float(v[0] * 2), float(v[1]), float(20 + v[2]), 1.0) for i, v in enumerate(p)], "id long, ra double, dec double, cz double, w double")
    path = str(tmp_path / "sky")
    first = cells.vpf_mocks(sky_, sky_, 5.0, 2, 20, 3, 1, 1, is_comoving_dist=True, centers=path).collect()
    assert cells.vpf_mocks(sky_, sky_, 5.0, 2, 20, 3, 1, 1, is_comoving_dist=True, centers=path).collect() == first


def test_accepted_centers_in_batches(spark):
    p = np.random.RandomState(6).rand(400, 3) * 20
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    dense = [i for i in range(400) if (d[i] < 3.0).sum() > 7]
    for wanted in (5, 37, 10_000):
        found = cells.accepted_centers(frame(spark, p), 3.0, wanted, 7).collect()
        assert [r.cid for r in found] == dense[:wanted]
    assert cells.accepted_centers(frame(spark, p), 3.0, 4, 400).count() == 0


def test_estimators(spark):
    d, r = np.random.RandomState(2).rand(200, 3) * 30, np.random.RandomState(3).rand(300, 3) * 30
    a, b, edges = frame(spark, d), frame(spark, r), [1.0, 3.0, 6.0]
    dd, dr, rr = (theory.DDrppi(x, 5.0, edges, y, boxsize=30.0) for x, y in ((a, None), (a, b), (b, None)))
    cf = estimators.convert_3d_counts_to_cf(200, 200, 300, 300, dd, dr, dr, rr).collect()
    n = [[x.npairs for x in t.collect()] for t in (dd, dr, rr)]
    f = 1.5
    expected = [(f * f * x - 2 * f * y + z) / z if z else math.nan for x, y, z in zip(*n)]
    assert [x.cf for x in cf] == pytest.approx(expected, nan_ok=True)
    wp = estimators.convert_rp_pi_counts_to_wp(200, 200, 300, 300, dd, dr, dr, rr, 2, 5.0).collect()
    assert [x.wp for x in wp] == pytest.approx([2 * sum(expected[:5]), 2 * sum(expected[5:])])
    again = estimators.wprp(200, 200, 300, 300, dd, dr, dr, rr, 5.0).collect()
    assert [x.wp for x in again] == pytest.approx([x.wp for x in wp])
    every = estimators.wprp(200, 200, 300, 300, dd, dr, dr, rr, 2.0, all_bins=True).collect()
    assert [x.wp for x in every] == pytest.approx([x.wp for x in wp])
    few = estimators.wprp(200, 200, 300, 300, dd, dr, dr, rr, 2.0).collect()
    assert [x.wp for x in few] == pytest.approx([2 * sum(expected[:2]), 2 * sum(expected[5:7])])
    with pytest.raises(ValueError, match="Landy"):
        estimators.convert_3d_counts_to_cf(1, 1, 1, 1, dd, dr, dr, rr, estimator="other")
    with pytest.raises(ValueError, match="whole number"):
        estimators.convert_rp_pi_counts_to_wp(1, 1, 1, 1, dd, dr, dr, rr, 2, 5.0, dpi=0.7)


def test_distances(spark):
    df = spark.createDataFrame([(0.0,), (0.1 * sky.LIGHT_SPEED,), (1.0 * sky.LIGHT_SPEED,)], "cz double")
    got = [r.dist for r in sky.with_distance(df, 1).orderBy("cz").collect()]
    z = np.linspace(0, 1, 200001)
    f = 1 / np.sqrt(0.25 * (1 + z) ** 3 + 0.75)
    whole = np.concatenate([[0], np.cumsum((f[1:] + f[:-1]) / 2) * (z[1] - z[0])]) * 2998.0
    assert got == pytest.approx([0.0, whole[20000], whole[-1]], rel=1e-8)
    with pytest.raises(ValueError):
        sky.distance_table(3)
    bad = spark.createDataFrame([(2.0 * sky.LIGHT_SPEED,)], "cz double")
    with pytest.raises(Exception, match="outside 0 to 1"):
        sky.with_distance(bad, 1).collect()
    few = spark.createDataFrame([(-10.0, 95.0, 0.5)], "ra double, dec double, cz double")
    assert tuple(sky.fix_cz(sky.fix_ra_dec(few)).first()) == (170.0, 5.0, 0.5 * sky.LIGHT_SPEED)


def test_distances_between_rows_of_the_table(spark):
    z = [(i + 0.5) * sky.TABLE_STEP for i in (0, 1, 777, 5000, 9999)]
    df = spark.createDataFrame([(v * sky.LIGHT_SPEED,) for v in z], "cz double")
    got = [r.dist for r in sky.with_distance(df, 2).orderBy("cz").collect()]
    k = np.arange(4001)
    f = lambda v: 1 / np.sqrt(0.302 * (1 + v * k / 4000) ** 3 + 0.698)
    simpson = np.where((k == 0) | (k == 4000), 1, np.where(k % 2, 4, 2))
    assert np.abs(np.array(got) - [2998.0 * v / 12000 * (simpson @ f(v)) for v in z]).max() < 1e-10


def test_fast_acos():
    x = np.linspace(-1, 1, 2001)
    assert np.abs(sky.fast_acos(x) - np.arccos(x)).max() < 1e-8


def test_sphere_lattice(spark):
    cells_ = sphere.gridlink_sphere(spark, 30.0).collect()
    assert len(cells_) == 18 and [sum(c.dec_band == i for c in cells_) for i in range(6)] == [2, 2, 5, 5, 2, 2]
    assert sphere.gridlink_sphere(spark, 60.0, dec_refine_factor=3, ra_refine_factor=2).count() == 36
    assert sphere.compute_nbins(180, 10) == 18 and sphere.compute_nbins(180, 10, 2, 20) == 20


def test_fastest_lattice(spark):
    p = frame(spark, np.random.RandomState(2).rand(60, 3) * 20)
    best, timings = sphere.fastest_lattice(lambda **options: theory.DD(p, [0.5, 2.0], boxsize=20.0, **options), max_refine=(2, 1, 1), repeats=1)
    assert set(best) == {"xbin_refine_factor", "ybin_refine_factor", "zbin_refine_factor"} and len(timings) == 2


def test_bins(tmp_path):
    path = tmp_path / "bins"
    path.write_text("# low high\n0.1 0.5\n\n0.5 2\n")
    assert bins.normalize_bins(str(path)) == [0.1, 0.5, 2.0]
    assert bins.normalize_bins([3, 1, 2]) == [1.0, 2.0, 3.0]
    assert len(bins.logbins(0.1, 10, 4)) == 5
    for bad in ([1.0], [1.0, 1.0]):
        with pytest.raises(ValueError):
            bins.normalize_bins(bad)


@pytest.mark.parametrize("double", [True, False])
def test_fastfood_round_trip(spark, tmp_path, double, monkeypatch):
    p = np.random.RandomState(0).rand(50, 3).astype(np.float32).astype(float)
    path = str(tmp_path / "points.ff")
    catalogs.write_fastfood_catalog(frame(spark, p), path, double=double)
    rows = sorted(tuple(r) for r in catalogs.read_catalog(spark, path).select("x", "y", "z", "w").collect())
    assert np.allclose(rows, sorted((*v, 1.0) for v in p.tolist()))
    catalogs.append_weights(path, np.full(50, 2.0))
    assert {r.w for r in catalogs.read_fastfood_catalog(spark, path).collect()} == {2.0}
    assert catalogs.read_fastfood_catalog(spark, path, need_weights=False).first().w is None
    catalogs.write_fastfood_catalog(frame(spark, p), path, weights=False)
    assert catalogs.read_catalog(spark, path).first().w is None
    with pytest.raises(ValueError, match="weights"):
        catalogs.read_fastfood_catalog(spark, path, need_weights=True)
    monkeypatch.setattr(catalogs, "PART_ROWS", 7)
    parts = catalogs.read_catalog(spark, path).orderBy("id").collect()
    assert [r.id for r in parts] == list(range(50)) and np.allclose([(r.x, r.y, r.z) for r in parts], p)
    catalogs.write_fastfood_catalog(frame(spark, p).limit(0), path)
    assert catalogs.read_catalog(spark, path).count() == 0
    (tmp_path / "broken.ff").write_bytes(b"\x14\0\0\0abc")
    with pytest.raises(Exception, match="lengths"):
        catalogs.read_catalog(spark, str(tmp_path / "broken.ff")).collect()


def test_ascii_and_centers(spark, tmp_path):
    path = tmp_path / "points.txt"
    path.write_text("# x y z w\n1 2 3 4\n5,6,7\nnot a point\n\n8\t9\t10\t11\n")
    rows = catalogs.read_catalog(spark, str(path)).orderBy("x").collect()
    assert [(r.x, r.y, r.z, r.w) for r in rows] == [(1, 2, 3, 4), (5, 6, 7, None), (8, 9, 10, 11)]
    assert catalogs.read_centers(spark, str(path), 4.0, 2).count() == 2
    assert catalogs.read_centers(spark, str(path), 5.0, 2) is None
    out = str(tmp_path / "counts")
    catalogs.write_counts(theory.DD(frame(spark, [[0, 0, 0], [0, 0, 1]]), [0.5, 2.0], boxsize=10.0), out, log_upper=True)
    assert spark.read.text(out).first()[0].split("\t")[1] == str(math.log10(2.0))


def test_growing_counts(spark, tmp_path):
    p = np.random.RandomState(9).rand(120, 3) * 20
    whole = frame(spark, p)
    counts = GrowingCounts(spark, str(tmp_path), [0.5, 2.0, 4.0], 20.0)
    for i in range(3):
        counts(whole.where(F.col("id") % 3 == i), i)
    counts(whole.where(F.col("id") % 3 == 2), 2)  # delivered again
    expected = [r.npairs for r in theory.DD(whole, [0.5, 2.0, 4.0], boxsize=20.0).collect()]
    assert [r.npairs for r in counts.table().collect()] == expected


def test_entry():
    import __spark_entry__ as e

    names = e.queries()
    assert "dd_auto_periodic" in names and set(e.oracle_sql()) <= set(names)
    assert os.path.isdir(e.SMOKE_DIR)

"""Pair counts against brute force, and against published example results."""

import dataclasses
import itertools
import pathlib
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyfield.functions.bins import logbins
from tallyfield.functions.weights import pair_product
from tallyfield.operators import mocks, paircount, theory
from tallyfield.plans import kernel, tiles
from tallyfield.plans.points import Extent, xyz


def frame(spark, p, w=None):
    w = np.ones(len(p)) if w is None else w
    rows = [(i, *map(float, v), float(x)) for i, (v, x) in enumerate(zip(p, w))]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, w double").repartition(3)


def clouds(box, n=100, seed=1234):
    rng = np.random.RandomState(seed)
    box = np.array(box, float)
    near = rng.rand(n // 2, 3) * 0.2 * box
    far = (0.5 + (rng.rand(n - n // 2, 3) - 0.5) * 0.4) * box
    return np.concatenate([near, far])


def separations(a, b, box=None):
    d = np.abs(a[:, None] - b[None])
    if box is not None:
        d = np.where(d >= np.array(box) / 2, np.array(box) - d, d)
    return d


def histogram(d, edges, keep=None):
    keep = np.ones(d.shape, bool) if keep is None else keep
    return [int(((d >= lo) & (d < hi) & keep).sum()) for lo, hi in itertools.pairwise(edges)]


@pytest.mark.parametrize("box", [(123.0,) * 3, (51.0, 75.0, 123.0)])
@pytest.mark.parametrize("cross", [False, True])
@pytest.mark.parametrize("periodic", [False, True])
def test_dd_brute_force(spark, box, cross, periodic):
    a, b = clouds(box), clouds(box, 70, 99)
    edges = np.linspace(0.01, (0.49 if periodic else 2.0) * min(box), 20)
    found = theory.DD(frame(spark, a), edges, frame(spark, b) if cross else None, periodic=periodic, boxsize=box).collect()
    d = separations(a, b if cross else a, box if periodic else None)
    assert [r.npairs for r in found] == histogram(np.sqrt((d**2).sum(-1)), edges)


def test_ddrppi_and_ddsmu_brute_force(spark):
    box = (51.0, 75.0, 123.0)
    a, b = clouds(box), clouds(box, 60, 7)
    edges, pimax = np.linspace(0.01, 24, 6), 20.0
    for other in (None, b):
        d = separations(a, a if other is None else b, box)
        rp, s = np.hypot(d[..., 0], d[..., 1]), np.sqrt((d**2).sum(-1))
        o = None if other is None else frame(spark, b)
        found = theory.DDrppi(frame(spark, a), pimax, edges, o, boxsize=box).collect()
        expected = [histogram(rp, e, (d[..., 2] >= j) & (d[..., 2] < j + 1))[0] for e in itertools.pairwise(edges) for j in range(20)]
        assert [r.npairs for r in found] == expected
        found = theory.DDsmu(frame(spark, a), edges, 0.5, 10, o, boxsize=box).collect()
        with np.errstate(invalid="ignore"):
            mu = np.where(s > 0, d[..., 2] / s, 0)
        expected = [histogram(s, e, (mu * 20 >= j) & (mu * 20 < j + 1))[0] for e in itertools.pairwise(edges) for j in range(10)]
        assert [r.npairs for r in found] == expected


def test_narrow_extents_and_edges(spark):
    one = frame(spark, np.zeros((1, 3)))
    assert [r.npairs for r in theory.DD(one, [0.2, 0.6, 1.0], boxsize=3.0).collect()] == [0, 0]
    two = frame(spark, np.array([[0, 0, 0], [0, 0, 0.5]]))
    assert [r.npairs for r in theory.DD(two, [0.2, 0.6, 1.0], boxsize=3.0).collect()] == [2, 0]
    box = 432.0
    straddling = frame(spark, np.array([[0.02 * box, 0, 0], [0.98 * box, 0, 0]]))
    assert [r.npairs for r in theory.DD(straddling, [0.01 * box, 0.4 * box], boxsize=box).collect()] == [2]
    half = frame(spark, np.array([[0, 0, 0], [0, 0, 0.48 * box]]))
    assert [r.npairs for r in theory.DD(half, [0.2 * box, 0.3 * box, 0.49 * box], boxsize=box).collect()] == [0, 2]
    with pytest.raises(ValueError, match="half"):
        theory.DD(two, [0.2, 2.0], boxsize=3.0)
    with pytest.raises(ValueError, match="box size"):
        theory.DD(two, [0.2, 0.6])


def test_empty_and_self_pairs(spark):
    empty = frame(spark, np.zeros((0, 3)))
    assert [r.npairs for r in theory.DD(empty, [0.1, 1.0], boxsize=10.0).collect()] == [0]
    p = frame(spark, np.array([[1.0, 1, 1], [1, 1, 1], [5, 5, 5]]), [2.0, 3.0, 4.0])
    r = theory.DD(p, [0.0, 1.0], boxsize=20.0, weight_type="pair_product").first()
    assert r.npairs == 3 + 2 and r.weightavg == pytest.approx((4 + 9 + 16 + 2 * 6) / 5)


def test_weight_function_of_the_user(spark):
    p = frame(spark, np.array([[1.0, 1, 1], [2, 1, 1]]), [2.0, 3.0])
    r = theory.DD(p, [0.5, 1.5], boxsize=20.0, weight_type=lambda a, b, dx, dy, dz: a + b + dx).first()
    assert r.weightavg == pytest.approx(6.0)


def test_invariance_and_sums(spark):
    box = 50.0
    p = np.random.RandomState(3).rand(300, 3) * box
    moved = (p[:, [1, 2, 0]] + 17.0) % box
    edges = [1.0, 3.0, 6.0]
    n = [r.npairs for r in theory.DD(frame(spark, p), edges, boxsize=box).collect()]
    assert n == [r.npairs for r in theory.DD(frame(spark, moved), edges, boxsize=box).collect()]
    crossed = [r.npairs for r in theory.DD(frame(spark, p), edges, frame(spark, p), boxsize=box).collect()]
    assert n == crossed
    flat = theory.DDrppi(frame(spark, p), 5.0, edges, boxsize=box).groupBy("rmin").agg(F.sum("npairs").alias("n")).orderBy("rmin").collect()
    assert [r.n for r in flat] == [r.npairs for r in theory.wp(frame(spark, p), box, 5.0, edges).collect()]


#: Published results for 10,000 uniform points of numpy seed 42 in a box of 420.
BINS = [0.167536, 0.238755, 0.340251, 0.484892, 0.691021, 0.984777, 1.40341, 2.0, 2.8502, 4.06184, 5.78853, 8.24925, 11.756, 16.7536, 23.8755]
DD_PAIRS = [0, 0, 0, 0, 2, 10, 36, 52, 210, 670, 2156, 5990, 17736, 50230]
DD_LAST_MEANS = [14.517498, 20.716714]
WP_PAIRS = [18, 16, 42, 66, 142, 298, 588, 1466, 2808, 5802, 11926, 23478, 47994, 98042]
WP = [66.717143, -15.786045, 2.998470, -15.779885, -11.966728, -9.699906, -11.698771, 3.848375, -0.921452, 0.454851, 1.428344, -1.067885, -0.553319, -0.086433]


def test_published_examples(spark):
    rng = np.random.RandomState(42)
    p = frame(spark, np.stack([rng.uniform(0, 420.0, 10000) for _ in range(3)], 1))
    found = theory.DD(p, BINS, boxsize=420.0, output_ravg=True, weight_type="pair_product").collect()
    assert [r.npairs for r in found] == DD_PAIRS
    assert [r.ravg for r in found[-2:]] == pytest.approx(DD_LAST_MEANS, abs=1e-6)
    assert all(r.weightavg == (1.0 if r.npairs else 0.0) for r in found)
    found = theory.wp(p, 420.0, 40.0, BINS).collect()
    assert [r.npairs for r in found] == WP_PAIRS
    assert [r.wp for r in found] == pytest.approx(WP, abs=1e-5)


def test_mocks_brute_force(spark):
    rng = np.random.RandomState(5)
    ra, dec, cz = rng.uniform(0, 360, 300), np.degrees(np.arcsin(rng.uniform(-1, 1, 300))), rng.uniform(10, 60, 300)
    df = spark.createDataFrame([(i, *map(float, v), 1.0) for i, v in enumerate(zip(ra, dec, cz))], "id long, ra double, dec double, cz double, w double")
    a, d = np.radians(ra), np.radians(dec)
    unit = np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], 1)
    off = ~np.eye(300, dtype=bool)
    theta = np.degrees(np.arccos(np.clip(unit @ unit.T, -1, 1)))
    edges = [1.0, 5.0, 20.0, 70.0, 150.0]
    assert [r.npairs for r in mocks.DDtheta_mocks(df, edges).collect()] == histogram(theta, edges, off)
    p = unit * cz[:, None]
    s, l = p[None] - p[:, None], p[None] + p[:, None]
    s2, l2, sl = (s * s).sum(-1), (l * l).sum(-1), (s * l).sum(-1)
    par, edges = np.abs(sl) / np.sqrt(l2), [0.5, 4.0, 12.0]
    rp = np.sqrt(np.maximum(0, s2 - par**2))
    expected = [histogram(rp, e, off & (par >= j) & (par < j + 1))[0] for e in itertools.pairwise(edges) for j in range(10)]
    assert [r.npairs for r in mocks.DDrppi_mocks(df, 1, 10.0, edges, is_comoving_dist=True).collect()] == expected
    mu = par / np.sqrt(np.where(off, s2, 1))
    expected = [histogram(np.sqrt(s2), e, off & (mu >= j / 5) & (mu < (j + 1) / 5))[0] for e in itertools.pairwise(edges) for j in range(5)]
    assert [r.npairs for r in mocks.DDsmu_mocks(df, 1, 1.0, 5, edges, is_comoving_dist=True).collect()] == expected


def test_points_from_any_table(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, [4.0, 5.0]), (1.0, 2.0, 3.0, None)], "a double, b double, c double, ws array<double>")
    rows = xyz(df, "a", "b", "c", weights="ws").collect()
    assert sorted(r.w for r in rows) == [1.0, 4.0]


def test_several_weights_go_to_functions_of_the_user(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, [4.0, 5.0]), (1.5, 1.0, 1.0, [6.0, None])], "a double, b double, c double, ws array<double>")
    points = xyz(df, "a", "b", "c", weights="ws")
    both = theory.DD(points, [0.1, 1.0], boxsize=9.0, weight_type=lambda a, b, *d: (a * b).sum(axis=0)).first()
    assert both.npairs == 2 and both.weightavg == pytest.approx(4 * 6 + 5 * 1)
    assert theory.DD(points, [0.1, 1.0], boxsize=9.0, weight_type="pair_product").first().weightavg == pytest.approx(24.0)
    with pytest.raises(Exception, match="at most 10"):
        xyz(spark.createDataFrame([(1.0, [1.0] * 11)], "a double, ws array<double>"), "a", "a", "a", weights="ws").collect()


@pytest.mark.parametrize("cross", [False, True])
def test_hot_tiles_are_split(spark, monkeypatch, cross):
    monkeypatch.setattr(tiles, "CHUNK", 37)
    monkeypatch.setattr(kernel, "PAIRS", 50)
    rng = np.random.RandomState(8)
    box, edges = 30.0, [0.0, 0.2, 1.0, 4.0]
    # a third of all points in one place, and repeated rows
    a = np.concatenate([rng.rand(160, 3) * box, 15 + rng.rand(90, 3) * 0.3, np.full((6, 3), 29.9)])
    b = np.concatenate([rng.rand(60, 3) * box, 15 + rng.rand(70, 3) * 0.3]) if cross else None
    w = rng.rand(len(a))
    other = frame(spark, b) if cross else None
    found = theory.DD(frame(spark, a, w), edges, other, boxsize=box, weight_type="pair_product", output_ravg=True).collect()
    d = np.sqrt((separations(a, b if cross else a, box) ** 2).sum(-1))
    ww = w[:, None] * (np.ones(len(b)) if cross else w)[None]
    for r, (lo, hi) in zip(found, itertools.pairwise(edges)):
        inside = (d >= lo) & (d < hi)
        assert r.npairs == inside.sum()
        assert r.ravg == pytest.approx(d[inside].mean()) and r.weightavg == pytest.approx(ww[inside].mean())


@pytest.mark.parametrize("boxsize", [(40.0, -1, 0), (0, 0, 0), (-1, -1, 55.0)])
def test_boxes_by_axis(spark, boxsize):
    p = np.random.RandomState(11).rand(250, 3) * [40.0, 30.0, 50.0]
    edges = [0.5, 4.0, 9.0]
    found = theory.DD(frame(spark, p), edges, boxsize=boxsize).collect()
    length = np.array([s if s > 0 else np.ptp(p[:, i]) if s == 0 else np.inf for i, s in enumerate(boxsize)])
    d = np.abs(p[:, None] - p[None])
    d = np.where(d >= length / 2, length - d, d)
    assert [r.npairs for r in found] == histogram(np.sqrt((d**2).sum(-1)), edges)


@pytest.mark.parametrize("options", [dict(xbin_refine_factor=1, ybin_refine_factor=1), dict(xbin_refine_factor=3, ybin_refine_factor=2, zbin_refine_factor=3), dict(enable_min_sep_opt=False), dict(max_cells_per_dim=2)])
def test_lattices_change_no_count(spark, options):
    box = (31.0, 22.0, 47.0)
    a, b = clouds(box, 200), clouds(box, 90, 3)
    for edges in ([0.01, 1.0, 3.0], [0.01, 5.0, 10.7]):
        for other in (None, b):
            d = separations(a, a if other is None else other, box)
            o = None if other is None else frame(spark, other)
            assert [r.npairs for r in theory.DD(frame(spark, a), edges, o, boxsize=box, **options).collect()] == histogram(np.sqrt((d**2).sum(-1)), edges)
            flat = theory.DDrppi(frame(spark, a), 8.0, edges, o, boxsize=box, **options).groupBy("rmin").agg(F.sum("npairs").alias("n")).orderBy("rmin").collect()
            assert [r.n for r in flat] == histogram(np.hypot(d[..., 0], d[..., 1]), edges, d[..., 2] < 8)
    with pytest.raises(ValueError, match="refine"):
        theory.DD(frame(spark, a), [0.1, 1.0], boxsize=box, xbin_refine_factor=0)


def test_plan_has_no_join_of_points(spark):
    p = frame(spark, np.random.RandomState(2).rand(50, 3) * 20)
    tiling = tiles.Tiling.plan(Extent.of(p), (2.0,) * 3, (20.0,) * 3, 64)
    assert all(n >= 3 for n in tiling.n)
    dealt = tiles.groups(tiling, p, None, ["x", "y", "z"], 50, 8)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    # each pair of neighbouring points meets in one group; copies go one way only
    assert dealt.where("shift = 13").count() == 50 and dealt.where("shift > 13").count() == 0
    many = tiles.groups(tiling, p, None, ["x", "y", "z"], 10**9, 8)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in many  # so many points that the list of hot tiles has no bound worth sending


def test_tilings_follow_reach_and_extent():
    whole = Extent(10**6, (0.0,) * 3, (100.0, 100.0, 0.0), 0.0, 0.0)
    t = tiles.Tiling.plan(whole, (3.0, 60.0, 1.0), (None,) * 3, 8)
    assert t.n[1] == 1 and t.n[2] == 1 and 8 <= t.n[0] <= 33 and all(s >= 3.0 for s in t.size[:2])


def test_wide_tiles_have_few_copies():
    # 54 million points and a reach of 4 in a box of 100
    t = tiles.Tiling.plan(Extent(54 * 10**6, (0.0,) * 3, (100.0,) * 3, 0.0, 0.0), (4.0,) * 3, (100.0,) * 3, 64)
    copies = (np.prod([1 + 2 * r / s for r, s in zip(t.reach, t.size)]) - 1) / 2
    assert copies < 2 and 54 * 10**6 / np.prod(t.n) * copies < tiles.CHUNK
    # all points in one tile still make groups for the cores
    assert tiles.chunk_size(900_000, 8) < 100_000 and tiles.chunk_size(150_000, 8) == tiles.LEAST_CHUNK


def counter(kind):
    edges = [0.25, 0.5, 1.0, 2.0, 3.0]
    if kind == "theta":
        falling = [-np.cos(np.radians(e)) for e in edges]

        def cosines(ax, ay, az, bx, by, bz):
            c = -(ax * bx + ay * by + az * bz)
            kept = np.flatnonzero((c >= falling[0]) & (c < falling[-1]))
            return kept, np.searchsorted(falling[1:-1], c[kept], "right"), lambda: np.degrees(np.arccos(np.clip(-c[kept], -1, 1)))

        return kernel.Binned("dot", cosines, tuple(falling), lambda v: np.degrees(np.arccos(np.clip(-v, -1, 1)))), 4, (0.06,) * 3
    if kind == "layers":
        return theory._projected(edges, 4.0, 4), 16, (3.0, 3.0, 4.0)
    return theory._radial(edges), 4, (3.0,) * 3


@pytest.mark.parametrize("kind", ["ball", "layers", "theta", "function"])
@pytest.mark.parametrize("weights", [None, "pair_product", "user"])
@pytest.mark.parametrize("corner", [False, True])
def test_blocks_count_as_pairs_do(kind, weights, corner, monkeypatch):
    rng = np.random.RandomState(5)
    metric, bins, reach = counter(kind)
    metric = metric.pairs if kind == "function" else metric
    theta = kind == "theta"
    size, n = (0.2, (2, 1, 1)) if theta else (8.0, (4, 4, 4))
    wrap = (None,) * 3 if theta else (32.0,) * 3
    origin = (0.0, 0.0, 0.85) if theta else (0.0,) * 3
    tiling = tiles.Tiling(origin, (size,) * 3, n, wrap, tuple(r * (1 + 1e-9) for r in reach))
    # own points of one tile, and copies of its neighbour's, over the edge of the box where it is in a corner
    place = np.zeros(3) if corner or theta else np.ones(3)
    x = (place + rng.rand(1500, 3)) * size
    y = (place + rng.rand(1200, 3) + [1 if theta else -1, 0, 0]) * size
    x[:300] = x[0] + (rng.rand(300, 3) - 0.5) * np.minimum(x[0] - place * size, (place + 1) * size - x[0]).min()  # a crowded place
    x[300:310] = x[310]
    if theta:
        for v in (x, y):
            v[:, 2] = np.sqrt(1 - v[:, 0] ** 2 - v[:, 1] ** 2)
    elif corner:
        y[:, 0] %= 32.0
    shift = np.r_[np.full(1500, 13), np.full(1200, 13 - 9 if theta else 13 + 9)]
    role = np.r_[np.full(1500, tiles.LEFT), np.full(1200, tiles.OTHER)]
    weigh = {None: None, "pair_product": pair_product, "user": lambda a, b, dx, dy, dz: a * b + dx + 2 * dz}[weights]
    key = (int(place @ [n[1] * n[2], n[2], 1]), 0, 0)
    found = []
    for least in (0, np.inf):
        monkeypatch.setattr(kernel, "DENSE", least)
        task = kernel.Task(tiling, kernel.Reach(kind != "layers"), metric, bins, theta, weights != "pair_product", weigh, False, True, True)
        found.append(sums := kernel.Sums(task))
        for step in (1 << 16, 1000):
            monkeypatch.setattr(kernel, "STEP", step)
            sums.group(key, role, shift, np.concatenate([x, y]), rng.__class__(3).rand(2700))
        if weights is None:
            task = kernel.Task(tiling, kernel.Reach(kind != "layers"), metric, bins, theta, False, None, False, True, False)
            counts = kernel.Sums(task)
            counts.group(key, role, shift, np.concatenate([x, y]), np.zeros(2700))
            assert (2 * counts.n == sums.n).all()
        assert (sums.lattice(2700) is None) == (least > 0)
    a, b = found
    assert a.n.sum() > 10_000 and (a.n == b.n).all() and a.alone == b.alone
    assert np.allclose(a.sep, b.sep) and np.allclose(a.w, b.w) and np.isclose(a.alone_w, b.alone_w)


def test_shuffled_points_are_packed(spark):
    rng = np.random.RandomState(4)
    p = rng.rand(4000, 3) * 100
    df = frame(spark, p, rng.rand(4000)).unionByName(spark.createDataFrame([(4000, None, 1.0, 1.0, 1.0)], "id long, x double, y double, z double, w double")).coalesce(1)
    # 54 million points and a reach of 4, as at 6 GB
    tiling = tiles.Tiling.plan(Extent(54 * 10**6, (0.0,) * 3, (100.0,) * 3, 0.0, 0.0), (4.0,) * 3, (100.0,) * 3, 64)
    rows = tiles.packed_groups(tiling, df, None, ["x", "y", "z", "w"], 4001, 8, 10**6).collect()
    found = [(r.tile, *v) for r in rows for role, shift, x in [tiles.unpack(r.data, 4)] for v in zip(role, shift, x.T.tolist())]
    assert sum(shift == 13 for _, _, shift, _ in found) == 4001 and [x[1:] for tile, *_, x in found if tile < 0] == [[1.0, 1.0, 1.0]]
    # fewer than 2.2 rows a point, and those of three coordinates in 24 bytes as the shuffle writes them, tile and all; rows took 27 before
    assert len(found) < 2.2 * 4001
    rows = tiles.packed_groups(dataclasses.replace(tiling, n=(2, 2, 2), size=(50.0,) * 3), df, None, ["x", "y", "z"], 4001, 8, 10**6).collect()
    raw = b"".join(bytes(r.data) for r in rows)
    assert len(pa.compress(raw, "lz4", asbytes=True)) < 22 * len(raw) / 25
    # the same points and copies, hot tiles cut or not, as rows dealt in SQL
    want = sorted((r.tile, r.role, r.shift, r.x, r.y, r.z, r.w) for r in tiles.groups(tiling, df, None, ["x", "y", "z", "w"], 4001, 8, 10**6).where("x is not null").collect())
    assert want == sorted((tile, int(role), int(shift), *x) for tile, role, shift, x in found if tile >= 0)


def test_rounds_of_tiles_follow_size_and_pairs():
    whole = Extent(54 * 10**6, (0.0,) * 3, (100.0,) * 3, 0.0, 0.0)
    for wrap in ((100.0,) * 3, (100.0, 100.0, None)):
        # 54 million points and a reach of 4: many pairs, so that no round has more than a sixth of the tiles
        t = tiles.Tiling.plan(whole, (4.0,) * 3, wrap, 64)
        boxes = paircount.rounds(t, whole, None, 4, True, 8)
        parts = [set(itertools.product(*map(range, b.first, b.last))) for b in boxes]
        assert sum(map(len, parts)) == len(set().union(*parts)) == np.prod(t.n) and max(map(len, parts)) * 6 <= np.prod(t.n)
    # as many with few pairs, or few points, are read once
    for n, reach in ((54 * 10**6, 0.5), (10**6, 4.0)):
        few = dataclasses.replace(whole, n=n)
        assert len(paircount.rounds(tiles.Tiling.plan(few, (reach,) * 3, (100.0,) * 3, 64), few, None, 4, True, 8)) == 1


@pytest.mark.parametrize("cross, box, arrays", [(False, (31.0, 0, -1), False), (True, (31.0, 22.0, 47.0), False), (False, None, True)])
def test_rounds_count_as_one_and_leave_no_files(spark, monkeypatch, cross, box, arrays):
    rng = np.random.RandomState(8)
    points = lambda seed, n: frame(spark, clouds((31.0, 22.0, 47.0), n, seed) - 5.0, rng.rand(n))
    a, b = points(1, 400), points(2, 150) if cross else None
    if arrays:
        a, b = (p and p.withColumn("ws", F.array("w")) for p in (a, b))
    else:  # a point without a place counts with itself alone
        a = a.unionByName(spark.createDataFrame([(400, None, 1.0, 1.0, 1.0)], a.schema))
    weigh = (lambda v, w, *_: v[0] * w[0]) if arrays else "pair_product"
    folders = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {f.name for d in folders for f in pathlib.Path(d).rglob("shuffle_*.data")}
    found, seen = [], []
    whole = paircount.rounds
    monkeypatch.setattr(paircount, "rounds", lambda *v: seen.append(whole(*v)) or seen[-1])
    for size in (paircount.ROUND, 5000):
        monkeypatch.setattr(paircount, "ROUND", size)
        monkeypatch.setattr(paircount, "MET", 0.01)
        monkeypatch.setattr(paircount, "ROUND_TILES", 0.25)
        before = shuffled()
        found.append([tuple(r) for r in theory.DD(a, [0.0, 1.0, 3.0, 5.0], b, periodic=box is not None, boxsize=box, weight_type=weigh, output_ravg=True).collect()])
    assert len(seen[0]) == 1 and len(seen[1]) > 2
    assert [r[3] for r in found[0]] == [r[3] for r in found[1]] and np.allclose(found[0], found[1], rtol=1e-12) and found[0][2][3] > 0
    deadline = time.monotonic() + 20
    while (left := shuffled() - before) and time.monotonic() < deadline:  # files go a moment later
        time.sleep(0.1)
    assert not left


@pytest.mark.parametrize("kind", ["ball", "layers"])
def test_pairs_on_edges_count_exactly(kind, monkeypatch):
    # separations that are edges, and nearer to them than single precision can tell
    metric, bins, reach = counter(kind)
    rng = np.random.RandomState(6)
    x = 1e3 + rng.randint(0, 32, (2000, 3)) / 4 + rng.choice([0.0, 1e-12, 1e-9], (2000, 3))
    tiling = tiles.Tiling((1e3,) * 3, (8.0,) * 3, (1,) * 3, (None,) * 3, tuple(r * (1 + 1e-9) for r in reach))
    task = kernel.Task(tiling, kernel.Reach(kind == "ball"), metric, bins, False, True, pair_product, False, True, False)
    w, found = rng.rand(2000), []
    for least in (0, np.inf):
        monkeypatch.setattr(kernel, "DENSE", least)
        found.append(sums := kernel.Sums(task))
        sums.group((0, 0, 0), np.full(2000, tiles.LEFT), np.full(2000, 13), x, w)
    a, b = found
    assert (a.n == b.n).all() and np.allclose(a.sep, b.sep, rtol=1e-12) and np.allclose(a.w, b.w, rtol=1e-12)


def test_only_open_edges_are_compared(monkeypatch):
    # of 7 edges a pair is compared with those that its block leaves open
    rng = np.random.RandomState(7)
    x = rng.rand(20_000, 3) * 9
    tiling = tiles.Tiling((0.0,) * 3, (9.0,) * 3, (1,) * 3, (None,) * 3, (4.0 * (1 + 1e-9),) * 3)
    seen = []
    whole = kernel.Sums.under
    monkeypatch.setattr(kernel.Sums, "under", lambda self, rough, i, value, x, y: seen.append(value.size) or whole(self, rough, i, value, x, y))
    sums = kernel.Sums(kernel.Task(tiling, kernel.Reach(), theory._radial([0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0]), 6, False, False, None, False, True, False))
    sums.group((0, 0, 0), np.full(20_000, tiles.LEFT), np.full(20_000, 13), x, np.zeros(20_000))
    assert sums.n.sum() > 3e7 and sum(seen) < 6 * sums.n.sum()


def test_more_published_examples(spark):
    rng = np.random.RandomState(42)
    p = frame(spark, np.stack([rng.uniform(0, 420.0, 100_000) for _ in range(3)], 1))
    # fixed values: published results for 100,000 uniform points of numpy seed 42 in a box of 420
    xi_pairs = [4, 12, 40, 106, 336, 1052, 2994, 8614, 24448, 70996, 207392, 601002, 1740084, 5028058]
    xi = [-0.205733, -0.176729, -0.051829, -0.131853, -0.049207, 0.028543, 0.011403, 0.005405, -0.014098, -0.010784, -0.001588, -0.000323, 0.000007, -0.001595]
    xi_means = [0.226592, 0.289277, 0.426819, 0.596187, 0.850100, 1.225112, 1.737153, 2.474588, 3.532018, 5.022241, 7.160648, 10.207213, 14.541171, 20.728773]
    found = theory.xi(p, 420.0, BINS, weight_type="pair_product", output_ravg=True).collect()
    assert [r.npairs for r in found] == xi_pairs
    assert [r.xi for r in found] == pytest.approx(xi, abs=1e-6) and [r.ravg for r in found] == pytest.approx(xi_means, abs=1e-6)
    half = theory.xi(p.withColumn("w", F.lit(0.5)), 420.0, BINS[-3:], weight_type="pair_product").collect()
    assert [r.weightavg for r in half] == pytest.approx([0.25, 0.25]) and [r.xi for r in half] == pytest.approx(xi[-2:], abs=1e-6)


def test_published_mu_and_angles(spark):
    rng = np.random.RandomState(42)
    p = frame(spark, np.stack([rng.uniform(0, 420.0, 10_000) for _ in range(3)], 1))
    # fixed values: published counts by mu of the bin from 5.78853 to 8.24925
    found = theory.DDsmu(p, BINS, 1.0, 10, boxsize=420.0).collect()
    assert [r.npairs for r in found[100:109]] == [230, 236, 210, 254, 182, 222, 238, 170, 208]
    rng = np.random.RandomState(42)
    ra = rng.uniform(0.0, 2.0 * np.pi, 100_000) * 180.0 / np.pi
    dec = 90.0 - np.arccos(rng.uniform(-1.0, 1.0, 100_000)) * 180.0 / np.pi
    sky = spark.createDataFrame([(i, float(a), float(d), 0.0, 1.0) for i, (a, d) in enumerate(zip(ra, dec))], "id long, ra double, dec double, cz double, w double")
    # fixed values: published counts and mean angles in the first 16 of 20 logarithmic bins from 0.01 to 10 degrees
    pairs = [62, 172, 298, 598, 1164, 2438, 4658, 9414, 19098, 37848, 75520, 150938, 301854, 599896, 1200238, 2396338]
    means = [0.012272, 0.016978, 0.024380, 0.034321, 0.048535, 0.068385, 0.096631, 0.136834, 0.192967, 0.272673, 0.385344, 0.543973, 0.768406, 1.085273, 1.533461, 2.166009]
    edges = logbins(0.01, 10.0, 20)[:17]
    found = mocks.DDtheta_mocks(sky, edges, output_thetaavg=True).collect()
    assert [r.npairs for r in found] == pairs and [r.thetaavg for r in found] == pytest.approx(means, abs=2e-6)


def test_single_precision_is_noticed(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a float, d float")
    with pytest.warns(UserWarning, match="single-precision"):
        mocks.DDtheta_mocks(mocks.sky(df, "a", "d", None), [0.01, 1.0])
    with pytest.warns(UserWarning, match="single-precision"):
        mocks.DDsmu_mocks(mocks.sky(df.withColumn("c", F.lit(5.0)), "a", "d", "c"), 1, 1.0, 2, [0.1, 1.0], is_comoving_dist=True)

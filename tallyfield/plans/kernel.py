"""Pairs of the points of one group, in NumPy.

Right points are sorted into a lattice of cells, columns of cells along z being
contiguous.  For each left point and each column in reach the cells in reach make
one range; columns and cells farther than the reach by their least separation are
left out.  Ranges are expanded to pairs a bounded number at a time, so memory
doesn't depend on how many pairs there are.

Where many points are in reach, blocks of left points near one another meet all
right points in reach of the block at once, as rows and columns of arrays that
stay in the cache.  Nothing is gathered by pair then, and bins of ``Binned``
metrics are counts of comparisons.  Those are made in single precision, on one
product of matrices around the middle of the block; pairs nearer to an edge than
its error are looked at again in double precision, with the arithmetic of single
pairs, so both ways give the same counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tallyfield.functions.weights import pair_product
from tallyfield.plans.tiles import LEFT, OTHER, RIGHT, Tiling, unpack

#: Pairs held at a time.
PAIRS = 1 << 19
#: Right points in the box around a left point from which on blocks meet; points of a block, about and at most; pairs of a block's step.
DENSE, BLOCK, MOST, STEP = 300, 128, 384, 1 << 16

#: Bound of the relative error of a product of matrices in single precision, of rows of five, with that of its factors.
SINGLE = 10 * 2.0**-24

#: From the separations along the axes, or from six coordinates: places of the pairs that count, their bin, their separation.
Metric = Callable[..., tuple[np.ndarray, np.ndarray, Callable[[], np.ndarray]]]


@dataclass(frozen=True)
class Binned:
    """A metric by rising edges of one value, which blocks can take as counts of comparisons.

    ``kind``: the value is the ``square`` of the separation, that ``across`` the z
    axis, or the ``dot`` product of two directions with the sign changed.  ``layers``: number of bins
    along z, their inverse width and the height.
    """

    kind: str
    pairs: Metric
    edges: tuple[float, ...]
    apart: Callable[[np.ndarray], np.ndarray]
    layers: tuple[int, float, float] | None = None

    def __call__(self, *v):
        return self.pairs(*v)


@dataclass(frozen=True)
class Reach:
    """How far pairs can be apart, and how fine the cells are.

    ``ball``: the first two reaches are one radius, and the third is it too;
    otherwise the third is a height apart from it (a cylinder).
    """

    ball: bool = True
    refine: tuple[int, int, int] = (2, 2, 1)
    max_cells: int | None = None
    prune: bool = True


@dataclass(frozen=True)
class Task:
    """What a task needs to know to count its groups."""

    tiling: Tiling
    reach: Reach
    metric: Metric
    bins: int
    coordinates: bool
    average: bool
    weigh: Callable | None
    arrays: bool
    both: bool
    self_pairs: bool


class Cells:
    """Right points in the order of their cells."""

    def __init__(self, u: np.ndarray, task: Task):
        t, r = task.tiling, task.reach
        room = [s + 2 * d for s, d in zip(t.size, t.reach)]
        size = [max(d / k, w / 2**20, 1e-300) for d, k, w in zip(t.reach, r.refine, room)]
        if r.max_cells:
            size = [max(c, s * n / r.max_cells) for c, s, n in zip(size, t.size, t.n)]
        # not many more cells than points
        excess = np.prod([max(1.0, w / c) for w, c in zip(room, size)]) / max(4096, 8 * len(u))
        while excess > 1:
            wide = [i for i in range(3) if room[i] > size[i]]
            grow = min([excess ** (1 / len(wide)) * 1.01, *[room[i] / size[i] for i in wide]])
            size = [c * grow if i in wide else c for i, c in enumerate(size)]
            excess = np.prod([max(1.0, w / c) for w, c in zip(room, size)]) / max(4096, 8 * len(u))
        self.size = np.array(size)
        self.low = np.array([-d for d in t.reach])
        self.n = np.array([int(w / c) + 1 for w, c in zip(room, size)])
        cell = self.of(u)
        key = (cell[:, 0] * self.n[1] + cell[:, 1]) * self.n[2] + cell[:, 2]
        self.order = np.argsort(key, kind="stable")
        self.cell = cell[self.order]
        self.u = u[self.order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=int(self.n.prod())))])

    def of(self, u: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((u - self.low) / self.size).astype(np.int64), 0, self.n - 1)


def ranges(u: np.ndarray, right: Cells, task: Task, half: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left points, and the first and number of the right points (in cell order) that each meets.

    ``half``: the left points are the right ones, in their order, and pairs are met once.
    """
    t, ball, prune = task.tiling, task.reach.ball, task.reach.prune
    cell = right.of(u)
    radius2, height = (max(t.reach[:2])) ** 2, t.reach[2]
    within = u - right.low - cell * right.size  # place in the own cell
    steps = [int(np.ceil(t.reach[i] / right.size[i])) for i in range(2)]

    def gap(axis: int, d: int) -> np.ndarray | float:
        if not d:
            return 0.0
        return np.maximum(0.0, d * right.size[axis] - within[:, axis] if d > 0 else within[:, axis] - (d + 1) * right.size[axis])

    out: tuple[list, list, list] = ([], [], [])
    z, places = u[:, 2] - right.low[2], np.arange(len(u))
    for dx in range(0 if half else -steps[0], steps[0] + 1):
        for dy in range(-steps[1], steps[1] + 1):
            if half and (dx, dy) < (0, 0):
                continue
            x, y = cell[:, 0] + dx, cell[:, 1] + dy
            ok = (x >= 0) & (x < right.n[0]) & (y >= 0) & (y < right.n[1])
            reach = height
            if prune:
                least2 = gap(0, dx) ** 2 + gap(1, dy) ** 2
                ok &= least2 <= radius2
                if ball:
                    reach = np.sqrt(np.maximum(0.0, radius2 - least2))[()]
            i = np.flatnonzero(ok)
            if not len(i):
                continue
            h = reach if np.ndim(reach) == 0 else reach[i]
            column = (x[i] * right.n[1] + y[i]) * right.n[2]
            lo = np.clip(np.floor((z[i] - h) / right.size[2]).astype(np.int64), 0, right.n[2] - 1)
            hi = np.clip(np.floor((z[i] + h) / right.size[2]).astype(np.int64), 0, right.n[2] - 1)
            first, last = right.start[column + lo], right.start[column + hi + 1]
            if half and not dx and not dy:
                first = np.maximum(first, places[i] + 1)
            some = np.flatnonzero(last > first)
            for column_, value in zip(out, (i[some], first[some], (last - first)[some])):
                column_.append(value)
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *v]) for v in out)


def pairs(left: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ranges as places of left and right points, about ``PAIRS`` at a time."""
    at, first, n = left
    while len(n) and n.max() > PAIRS:  # a range longer than a block is cut
        more = np.minimum(n, PAIRS)
        rest = np.flatnonzero(n > PAIRS)
        at, first, n = np.concatenate([at, at[rest]]), np.concatenate([first, first[rest] + PAIRS]), np.concatenate([more, n[rest] - PAIRS])
    ends = np.cumsum(n)
    begin = 0
    while begin < len(n):
        done = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        k = n[begin:stop]
        shift = first[begin:stop] - (ends[begin:stop] - k - done)
        yield np.repeat(at[begin:stop], k), np.arange(k.sum()) + np.repeat(shift, k)
        begin = stop


class Columns:
    """Points by columns of cells along z, and by z in each."""

    def __init__(self, u: np.ndarray, low: np.ndarray, size: float, n: tuple[int, int, int], height: float):
        self.cell = np.clip(np.floor((u - low) / size).astype(np.int64), 0, np.array(n) - 1)
        column = self.cell[:, 0] * n[1] + self.cell[:, 1]
        self.order = np.lexsort((u[:, 2], column))
        self.u, self.cell, column = u[self.order], self.cell[self.order], column[self.order]
        self.z = self.u[:, 2] - low[2]
        self.across = np.ascontiguousarray(self.u.T)
        self.single = self.across.astype(np.float32)
        #: Column and z as one number.
        self.key = column * height + self.z

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """First points of runs of one cell, ``MOST`` points long at most, and their ends."""
        size = len(self.u)
        cells = np.flatnonzero(np.r_[True, (self.cell[1:] != self.cell[:-1]).any(axis=1)])
        place = np.arange(size) - np.repeat(cells, np.diff(np.r_[cells, size]))
        first = np.flatnonzero(place % MOST == 0)
        return first, np.r_[first[1:], size]


def heights(bins: int, scale: float, height: float) -> list[float]:
    """The least values that times ``scale`` are 1, 2 and so on, and the height."""
    out = []
    for j in range(1, bins):
        t = j / scale
        while t * scale >= j:
            t = np.nextafter(t, 0.0)
        while t * scale < j:
            t = np.nextafter(t, np.inf)
        out.append(min(float(t), height))
    return [*out, height]


class Rough:
    """Squared separations of a block's points and others as one product of matrices in single precision, and what each edge may be off by.

    Positions are taken from the middle of the block, so that numbers are no
    larger than what is in reach; separations are divided by the largest.
    """

    def __init__(self, axes: int, limits: np.ndarray, wrap, x: np.ndarray, y: np.ndarray):
        self.axes = axes
        centre = (x.min(axis=1) + x.max(axis=1))[:axes, None] / 2
        p, q = (v[:axes] - centre for v in (x, y))
        far = np.abs(centre).max()
        for v, length in zip(q, wrap):
            if length is not None:
                far = max(far, length)
                if v.max() > length / 2 or v.min() < -length / 2:
                    v -= length * np.round(v / length)
        p2, q2 = (np.einsum("ij,ij->j", v, v) for v in (p, q))
        scale = 1 / ((np.sqrt(p2.max()) + np.sqrt(q2.max())) or 1.0)
        self.left, self.right = np.ones((p.shape[1], axes + 2), np.float32), np.ones((axes + 2, q.shape[1]), np.float32)
        self.left[:, :axes], self.right[:axes] = p.T * scale, q * (-2 * scale)
        self.left[:, axes], self.right[axes + 1] = p2 * scale**2, q2 * scale**2
        self.double = (p, p2), (q, q2)
        # directions are a little off the length of 1
        error, limits = SINGLE + 2.0**-48 * (far * scale + scale**2), limits * scale**2
        self.around = list(zip(np.nextafter((limits - error).astype(np.float32), np.float32(-np.inf)), np.nextafter((limits + error).astype(np.float32), np.float32(np.inf))))

    def exact(self, some: slice, out: np.ndarray) -> np.ndarray:
        """Squared separations from some right points, in double precision."""
        (p, p2), (q, q2) = self.double
        left = np.stack([*p, p2, np.ones(len(p2))], axis=1)
        right = np.stack([*(-2 * q[:, some]), np.ones(out.shape[1]), q2[some]])
        return np.maximum(np.matmul(left, right, out=out), 0.0, out=out)


class Sums:
    """Pairs, separations and weights by bin."""

    def __init__(self, task: Task):
        self.task = task
        self.n = np.zeros(task.bins, np.int64)
        self.sep, self.w = np.zeros(task.bins), np.zeros(task.bins)
        #: Points that count with themselves, and their weights.
        self.alone, self.alone_w = 0, 0.0
        self.held: dict[str, np.ndarray] = {}
        #: Heights below which a pair is in the first layer, the first two and so on.
        self.by_edges = isinstance(task.metric, Binned) and task.weigh in (None, pair_product)
        self.heights = heights(*task.metric.layers) if self.by_edges and task.metric.layers else []
        if self.by_edges:
            #: The edges as squared separations.
            self.limits = np.array(task.metric.edges) * (2 if task.metric.kind == "dot" else 1) + (2 if task.metric.kind == "dot" else 0)

    def relative(self, x: np.ndarray, tile: int, shift: np.ndarray) -> np.ndarray:
        """Places in the tile: from 0 to its size for its own points, beyond that for copies."""
        t, out = self.task.tiling, np.empty_like(x)
        target = (tile // (t.n[1] * t.n[2]), tile // t.n[2] % t.n[1], tile % t.n[2])
        for i in range(3):
            way = shift // 3 ** (2 - i) % 3 - 1
            u = x[:, i] - t.origin[i] - ((target[i] - way) % t.n[i]) * t.size[i]
            if t.wrap[i] is not None:
                u = u - t.wrap[i] * np.round((u - t.size[i] / 2) / t.wrap[i])
            out[:, i] = u - way * t.size[i]
        return out

    def meet(self, u, x, w, right: Cells, xr, wr, half: bool) -> None:
        """Count left points against right ones; for ``half`` both are in the cells' order."""
        task, t = self.task, self.task.tiling
        # where cells reach over half the box, a pair could be met by two images
        narrow = [i for i in range(3) if t.wrap[i] is not None and (np.ceil(t.reach[i] / right.size[i]) + 1) * right.size[i] >= t.wrap[i] / 2]
        for a, b in pairs(ranges(u, right, task, half)):
            for i in narrow:
                image = np.flatnonzero(np.abs(u[a, i] - right.u[b, i]) <= t.wrap[i] / 2)
                a, b = a[image], b[image]
            self.add(a, b, x, w, xr, wr)

    def add(self, a, b, x, w, xr, wr) -> None:
        """Count pairs of the places ``a`` and ``b``."""
        task = self.task
        if task.coordinates:
            found = task.metric(*(x[i][a] for i in range(3)), *(xr[i][b] for i in range(3)))
        else:
            found = task.metric(*self.apart(x, xr, a, b))
        kept, bins, separation = found
        if not len(kept):
            return
        self.n += np.bincount(bins, minlength=task.bins)
        if task.average:
            self.sep += np.bincount(bins, separation(), task.bins)
        if task.weigh:
            a, b = a[kept], b[kept]
            self.w += np.bincount(bins, np.broadcast_to(task.weigh(w[..., a], wr[..., b], *self.apart(x, xr, a, b)), bins.shape), task.bins)

    def lattice(self, n: int) -> tuple[np.ndarray, float, tuple[int, int, int], float] | None:
        """Origin, size and number of the cells for blocks among ``n`` right points, and a number above all heights; None where too few are in reach."""
        t = self.task.tiling
        room = np.array([s + 2 * d for s, d in zip(t.size, t.reach)])
        box = np.minimum(room, 2 * np.array(t.reach))
        if n * np.prod(box / room) < DENSE:
            return None
        wide = max(t.reach)
        size = min(wide, max((np.prod(t.size) * BLOCK / n) ** (1 / 3), wide / 10))
        # an image beyond half the box must not be in the columns read
        if any(length is not None and d + 2 * size >= length / 2 for length, d in zip(t.wrap, t.reach)):
            return None
        return -np.array(t.reach), size, tuple(int(r / size) + 1 for r in room), 1.001 * room[2] + size

    def meet_blocks(self, lattice, left: Columns, x, w, right: Columns, xr, wr, half: bool) -> None:
        """As ``meet``, by blocks of left points; both sets are in the order of their columns."""
        t, ball = self.task.tiling, self.task.reach.ball
        low, size, n, height = lattice
        radius, tall = max(t.reach[:2]), t.reach[2]
        slack = 4 * np.spacing(n[0] * n[1] * height)
        axes = 3 if ball else 2
        first, end = left.blocks()
        bounds = [(np.minimum.reduceat(v, first) - o, np.maximum.reduceat(v, first) - o) for v, o in zip(left.u.T[:2], low)]
        step = int(np.ceil(radius / size)) + 1
        ways = [(dx, dy) for dx in range(-step, step + 1) for dy in range(-step, step + 1) if not half or (dx, dy) >= (0, 0)]
        ways = [way for way in ways if sum(max(0, abs(d) - 1) ** 2 for d in way) * size**2 * (1 - 1e-9) <= radius * radius]
        if half:
            at = np.arange(len(left.u))
            rest = np.repeat(end, end - first) - at - 1
            for a, b in pairs((at[rest > 0], at[rest > 0] + 1, rest[rest > 0])):
                self.add(a, b, x, w, xr, wr)
        batch = max(1, (1 << 20) // len(ways))
        for begin in range(0, len(first), batch):
            some = slice(begin, begin + batch)
            p, q = first[some], end[some]
            cell = left.cell[p]
            lo, hi = np.zeros((len(p), len(ways)), np.int64), np.zeros((len(p), len(ways)), np.int64)
            for k, way in enumerate(ways):
                column = [cell[:, i] + way[i] for i in range(2)]
                ok, least2 = np.ones(len(p), bool), np.zeros(len(p))
                for i in range(2):
                    ok &= (column[i] >= 0) & (column[i] < n[i])
                    if way[i]:
                        gap = column[i] * size - bounds[i][1][some] if way[i] > 0 else bounds[i][0][some] - (column[i] + 1) * size
                        least2 += np.maximum(gap - slack, 0.0) ** 2
                near = np.flatnonzero(ok & (least2 <= radius * radius))
                h = np.sqrt(radius * radius - least2[near]) if ball else tall
                at = (column[0] * n[1] + column[1])[near] * height
                lo[near, k] = np.searchsorted(right.key, at + np.maximum(left.z[p[near]] - h - slack, 0.0) - slack)
                hi[near, k] = np.searchsorted(right.key, at + np.minimum(left.z[q[near] - 1] + h + slack, height - size / 2) + slack, "right")
                if way == (0, 0) and half:
                    lo[:, k] = np.maximum(lo[:, k], q)
            for k in range(len(p)):
                length = np.maximum(hi[k] - lo[k], 0)
                found = np.flatnonzero(length)
                if not len(found):
                    continue
                length = length[found]
                ends = np.cumsum(length)
                b = np.arange(ends[-1]) + np.repeat(lo[k, found] - ends + length, length)
                mine = slice(p[k], q[k])
                if self.by_edges:
                    self.block_by_edges(left.u[mine], x[:, mine], w[..., mine], right, b, xr, wr)
                    continue
                # columns reach beyond the corners of what the block can reach
                gap2 = 0.0
                for v, far in zip(left.u.T[:axes], right.across):
                    own, far = v[mine], far[b]
                    gap2 = gap2 + np.square(far - np.clip(far, own.min(), own.max()))
                b = b[gap2 <= radius * radius]
                self.block(x[:, mine], w[..., mine], xr[:, b], wr[..., b])

    def block(self, x, w, xr, wr) -> None:
        """Every left point against every right one, a step of columns at a time."""
        task, m = self.task, x.shape[1]
        wide = max(1, STEP // m)
        for begin in range(0, xr.shape[1], wide):
            y, wy = xr[:, begin : begin + wide], wr[..., begin : begin + wide]
            k = y.shape[1]
            found = task.metric(*(np.repeat(v, k) for v in x), *(np.tile(v, m) for v in y)) if task.coordinates else task.metric(*(v.ravel() for v in self.axes(x, y)))
            kept, bins, separation = found
            if not len(kept):
                continue
            self.n += np.bincount(bins, minlength=task.bins)
            if task.average:
                self.sep += np.bincount(bins, separation(), task.bins)
            if task.weigh is pair_product:
                self.w += np.bincount(bins, (w[:, None] * wy).ravel()[kept], task.bins)
            elif task.weigh:
                a, b = np.divmod(kept, k)
                self.w += np.bincount(bins, np.broadcast_to(task.weigh(w[..., a], wy[..., b], *self.apart(x, y, a, b)), bins.shape), task.bins)

    def block_by_edges(self, u, x, w, right: Columns, b, xr, wr) -> None:
        """As ``block`` for a ``Binned`` metric, with right points (places ``b``) in runs for which the same edges are open.

        By the box around the block, the pairs of a right point may all be under an
        edge, or none; only the edges between need to be compared.
        """
        t, m = self.task.tiling, len(u)
        span = [s + 2 * d for s, d in zip(t.size, t.reach)]
        slack = 2.0**-20 * max(span) + 2.0**-46 * max(map(abs, t.origin))
        axes, limits, tall = 2 if self.heights else 3, self.limits.astype(np.float32), np.array(self.heights, np.float32)
        near, far = [], []
        for i in range(3):
            lo, hi = u[:, i].min(), u[:, i].max()
            d = np.abs(right.single[i][b] - np.float32((lo + hi) / 2))
            half = np.float32((hi - lo) / 2 + slack)
            near.append(np.maximum(d - half, np.float32(0)))
            far.append(d + half)

        def passed(value, edges) -> np.ndarray:
            n = np.zeros(len(value), np.uint8 if len(edges) < 256 else np.int32)
            for e in edges:
                n += value >= e
            return n

        edges, layers = len(limits), len(tall)
        low, high = (passed(sum(v * v for v in side[:axes]), limits) for side in (near, far))
        key, kept = low * np.int32(edges + 1) + high, low < edges
        if layers:
            low, high = passed(near[2], tall), passed(far[2], tall)
            key = (key * (layers + 1) + low) * (layers + 1) + high
            kept &= low < layers
        kept = np.flatnonzero(kept)
        if not len(kept):
            return
        key = key[kept]
        order = np.argsort(key.astype(np.uint16) if (edges + 1) ** 2 * (layers + 1) ** 2 <= 1 << 16 else key, kind="stable")
        key, b = key[order], b[kept[order]]
        y, wy = xr[:, b], wr[..., b]
        rough = Rough(axes, self.limits, t.wrap, x, y)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        low, z = np.divmod(key[first].astype(np.int64), (layers + 1) ** 2)
        open_ = np.stack([*np.divmod(low, edges + 1), *np.divmod(z, layers + 1)], axis=1).tolist()
        n, sums = np.zeros((edges, max(1, layers) + 1), np.int64), np.zeros((2, edges, max(1, layers) + 1))
        wide = max(1, STEP // m)
        begin, now = 0, open_[0]
        for end, following in zip([*first[1:].tolist(), len(key)], [*open_[1:], None]):
            if following and end - begin < wide // 2:  # short runs are taken together, with the edges of both open
                now = [f(v) for f, v in zip((min, max, min, max), zip(now, following))]
                continue
            for at in range(begin, end, wide):
                some = slice(at, min(at + wide, end))
                self.run(rough, some, now, x, w, y[:, some], wy[..., some], n, sums)
            begin, now = end, following
        self.n += np.diff(np.diff(n, axis=0), axis=1).ravel()
        sep, weight = np.diff(np.diff(sums, axis=1), axis=2).reshape(2, -1)
        self.sep += sep
        self.w += weight

    def run(self, rough: Rough, some: slice, open_: list[int], x, w, y, wy, n, sums) -> None:
        """Right points for which edges, and heights, are open from the first to the second number; all pairs are under those beyond.

        Adds to numbers and sums under each edge and height.
        """
        task, shape = self.task, (x.shape[1], y.shape[1])
        edge, all_edges, height, all_heights = open_
        edges, layers = len(self.limits), max(1, len(self.heights))
        value = np.matmul(rough.left, rough.right[:, some], out=self.room("rough", shape, np.float32)) if all_edges > edge else None
        below = {}
        if all_heights > height:
            along = self.axis(2, x, y)
            below = {j: np.less(along, self.heights[j], out=self.room(f"below {j}", shape, bool)) for j in range(height, all_heights)}
        apart = None
        if task.average:
            apart = self.products(x, y) if task.metric.kind == "dot" else rough.exact(some, self.room("exact", shape))
            apart = task.metric.apart(apart.ravel())
        last, end = min(all_edges, edges - 1), min(all_heights, layers - 1)

        def total(i: int, j: int, under, beneath) -> None:
            # all edges from the last on have the same pairs under them
            to = slice(i, None if i == last else i + 1), slice(j + 1, None if j == end else j + 2)
            if under is None and beneath is None:
                n[to] += shape[0] * shape[1]
                if apart is not None:
                    sums[0][to] += apart.sum()
                if task.weigh:
                    sums[1][to] += w.sum() * wy.sum()
                return
            mask = beneath if under is None else under if beneath is None else np.logical_and(under, beneath, out=self.room("both", shape, bool))
            found = np.count_nonzero(mask)
            n[to] += found
            if not found or not (task.average or task.weigh):
                return
            ones = self.room("ones", shape)
            ones[:] = mask
            if apart is not None:
                sums[0][to] += ones.ravel() @ apart
            if task.weigh:
                sums[1][to] += w @ (ones @ wy)

        for i in range(edge, last + 1):
            under = self.under(rough, i, value, x, y) if i < all_edges else None
            for j in range(height, end + 1):
                total(i, j, under, below.get(j))

    def under(self, rough: Rough, i: int, value: np.ndarray, x, y) -> np.ndarray:
        """The pairs under an edge."""
        low, high = rough.around[i]
        sure = np.less(value, low, out=self.room("under", value.shape, bool))
        maybe = np.less(value, high, out=self.room("maybe", value.shape, bool))
        if np.count_nonzero(maybe) != np.count_nonzero(sure):
            at = np.flatnonzero(np.not_equal(sure, maybe, out=maybe))
            a, b = np.divmod(at, value.shape[1])
            if self.task.metric.kind == "dot":
                exact = sum(-x[k][a] * y[k][b] for k in range(3))
            else:
                exact = sum(d * d for _, d in zip(range(rough.axes), self.apart(x, y, a, b)))
            sure.ravel()[at] = exact < self.task.metric.edges[i]
        return sure

    def room(self, name: str, shape: tuple[int, int], kind=float) -> np.ndarray:
        """An array that is used again and again."""
        if name not in self.held or self.held[name].size < shape[0] * shape[1]:
            self.held[name] = np.empty(max(STEP, shape[0] * shape[1]), kind)
        return self.held[name][: shape[0] * shape[1]].reshape(shape)

    def axis(self, i: int, x, y) -> np.ndarray:
        """Separations along an axis, by the nearest image where it is periodic."""
        d = np.subtract(x[i][:, None], y[i], out=self.room(f"axis {i}", (x.shape[1], y.shape[1])))
        np.abs(d, out=d)
        length = self.task.tiling.wrap[i]
        if length is not None and max(x[i].max() - y[i].min(), y[i].max() - x[i].min()) > length / 2:
            np.minimum(d, length - d, out=d)
        return d

    def axes(self, x, y) -> Iterator[np.ndarray]:
        return (self.axis(i, x, y) for i in range(3))

    def products(self, x, y) -> np.ndarray:
        """Dot products with the sign changed."""
        shape = (x.shape[1], y.shape[1])
        value = np.multiply(-x[0][:, None], y[0], out=self.room("axis 0", shape))
        for i in (1, 2):
            value += np.multiply(-x[i][:, None], y[i], out=self.room("axis 1", shape))
        return value

    def apart(self, x, xr, a, b) -> Iterator[np.ndarray]:
        """Separations along the axes, by the nearest image where they are periodic."""
        for i in range(3):
            d = np.abs(x[i][a] - xr[i][b])
            length = self.task.tiling.wrap[i]
            yield d if length is None else np.minimum(d, length - d)

    def group(self, key: tuple[int, int, int], role: np.ndarray, shift: np.ndarray, x: np.ndarray, w: np.ndarray) -> None:
        """Count one group: rows of ``x`` are points, the last axis of ``w`` is theirs."""
        task = self.task
        of = lambda r: np.flatnonzero(role == r)
        left = of(LEFT)
        if not len(left):
            return
        if key[0] < 0:  # points without a place meet none
            if task.both:
                self.add_alone(w[..., left])
            return
        u = self.relative(x, key[0], shift)
        own = key[1] == key[2] and task.both
        met = of(RIGHT), of(OTHER)
        if lattice := self.lattice(max(len(left) if own else 0, *map(len, met))):
            self.group_blocks(lattice, own, left, met, u, x, w)
            return
        if own:
            cells = Cells(u[left], task)
            left = left[cells.order]
        xl, ul, wl = np.ascontiguousarray(x[left].T), u[left], w[..., left]
        if own:
            self.meet(ul, xl, wl, cells, xl, wl, True)
            self.add_alone(wl)
        for found in met:
            if len(found):
                cells = Cells(u[found], task)
                found = found[cells.order]
                self.meet(ul, xl, wl, cells, np.ascontiguousarray(x[found].T), w[..., found], False)

    def group_blocks(self, lattice, own: bool, left: np.ndarray, met: tuple[np.ndarray, ...], u, x, w) -> None:
        """The rest of ``group`` where blocks meet."""
        columns = Columns(u[left], *lattice)
        left = left[columns.order]
        xl, wl = np.ascontiguousarray(x[left].T), w[..., left]
        if own:
            self.meet_blocks(lattice, columns, xl, wl, columns, xl, wl, True)
            self.add_alone(wl)
        for found in met:
            if len(found):
                right = Columns(u[found], *lattice)
                found = found[right.order]
                self.meet_blocks(lattice, columns, xl, wl, right, np.ascontiguousarray(x[found].T), w[..., found], False)

    def add_alone(self, w: np.ndarray) -> None:
        """Each point with itself."""
        if self.task.self_pairs:
            self.alone += w.shape[-1]
            if self.task.weigh:
                none = np.zeros(w.shape[-1])
                self.alone_w += float(np.broadcast_to(self.task.weigh(w, w, none, none, none), none.shape).sum())

    def rows(self) -> pa.RecordBatch:
        """Bins with pairs; one set's pairs in both orders, a point with itself once."""
        twice = 2 if self.task.both else 1
        n, sep, w = self.n * twice, self.sep * twice, self.w * twice
        n[0] += self.alone
        w[0] += self.alone_w
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(sep[some]), pa.array(w[some])], names=["bin", "npairs", "sum_sep", "sum_w"])


def counted(task: Task, is_packed: bool):
    """The function for ``mapInArrow`` over rows of ``tiles.packed_groups``, or of ``tiles.groups``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(task)
        held: list[tuple] = []
        last = None

        def packed(b: pa.RecordBatch, lo: int, hi: int) -> Iterator[tuple]:
            for k in range(lo, hi):
                role, shift, v = unpack(b.column(3)[k].as_buffer(), 4 if task.weigh else 3)
                yield role, shift, v[:3].T, v[3] if task.weigh else np.zeros(0)

        def plain(b: pa.RecordBatch, lo: int, hi: int) -> Iterator[tuple]:
            some = b.slice(lo, hi - lo)
            if task.arrays:
                w = np.array(some.column(8).to_pylist(), float).reshape(hi - lo, -1)
            else:
                w = some.column(8).to_numpy(zero_copy_only=False) if task.weigh else np.zeros(0)
            yield some.column(3).to_numpy(), some.column(4).to_numpy(), np.stack([some.column(i).to_numpy(zero_copy_only=False) for i in (5, 6, 7)], 1), w

        def close():
            role, shift, x, w = (np.concatenate(v) for v in zip(*held))
            held.clear()
            sums.group(last, role, shift.astype(np.int64), x, w.T if task.arrays else w if task.weigh else np.zeros(len(role)))

        for b in batches:
            if not b.num_rows:
                continue
            head = np.stack([b.column(i).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            edge = np.flatnonzero((head[:, 1:] != head[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), b.num_rows]):
                key = tuple(head[:, lo].tolist())
                if last is not None and key != last:
                    close()
                last = key
                held.extend((packed if is_packed else plain)(b, lo, hi))
        if last is not None:
            close()
        yield sums.rows()

    return run

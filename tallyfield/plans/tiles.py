"""Tiles that turn a distance join into one shuffle of points, with hot tiles split.

Space is cut into tiles at least as wide as the reach.  A point goes to its own
tile and, as a copy, to those neighbours that it can reach; for one set with
itself only to neighbours on one side, so that each pair meets once.  All that a
tile needs then stands in one group, and no join is left: the pairs of a group are
found by ``plans.kernel``.

Tiles are several reaches wide where memory allows, as copies are few then: at
four reaches 1.2 for each point of one set, at one reach 13.

Points are shuffled as packed arrays of many, not as rows: bytes of like weight
stand together, so that exponents and tile numbers take next to nothing on disk.

A tile with more than ``CHUNK`` points is cut into chunks by a hash of their ids,
and its pairs of chunks are groups of their own, so that no group grows with the
densest place of the data.  Its own points and copies are cut each by their own
number.

Where a point meets many others, tiles may be taken in rounds, a box of tiles at a
time.  Each round reads all points again and shuffles those that its tiles need,
so that shuffle files on disk are those of one round.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyfield.plans.points import Extent

#: Points of a tile on average where the reach doesn't make it wider, and of a chunk at most.
TILE, CHUNK = 4096, 524_288
#: Points of a chunk of which smaller ones aren't made for parallelism.
LEAST_CHUNK = 16_384
#: Rows of a tile on average, copies too, up to which it is made wider than the reach, and by how much.
ROWS, WIDER = 600_000, (4, 3, 2, 1.5, 1)
#: Hot tiles of which the list is broadcast; their number is bounded by that of the points over ``CHUNK``.
BROADCAST = 50_000
#: Rows that a task gets on average at most.
TASK_ROWS = 200_000
#: Rows that are packed at a time.
PACKED = 1 << 17
#: Bytes of points that a round shuffles at most where there can be rounds enough, and rounds at most.
ROUND, MOST_ROUNDS = 200_000_000, 64
#: Points that a point meets for each round, so that reading again costs little beside them, and a round's tiles for each core.
MET, ROUND_TILES = 400, 3
#: A group's rows: left points, right points of the same set, other right points.
LEFT, RIGHT, OTHER = 0, 1, 2


def wrap_lengths(extent: Extent, boxsize, periodic: bool) -> tuple[float | None, ...]:
    """Length of each axis, None where it isn't periodic.

    A size above zero is the length, zero stands for the extent of the data and
    -1 for an axis that isn't periodic.
    """
    if not periodic:
        return (None,) * 3
    if boxsize is None:
        raise ValueError("a periodic calculation needs a box size")
    sizes = tuple(boxsize) if isinstance(boxsize, (tuple, list)) else (boxsize,) * 3
    if len(sizes) != 3 or any(s < 0 and s != -1 for s in sizes):
        raise ValueError("a box size is one number or three: positive, 0 or -1")
    return tuple(None if s == -1 else float(s) if s > 0 else hi - lo for s, lo, hi in zip(sizes, extent.low, extent.high))


@dataclass(frozen=True)
class Box:
    """Tiles from the first to before the last on each axis."""

    first: tuple[int, int, int]
    last: tuple[int, int, int]


@dataclass(frozen=True)
class Tiling:
    """Origin, size and number of tiles on each axis, its length where it is periodic, and the reach.

    The reach is a little wider than asked for, against roundoff; exact tests follow.
    """

    origin: tuple[float, float, float]
    size: tuple[float, float, float]
    n: tuple[int, int, int]
    wrap: tuple[float | None, float | None, float | None]
    reach: tuple[float, float, float]

    @staticmethod
    def plan(extent: Extent, reach: tuple[float, float, float], wrap: tuple[float | None, ...], least: int) -> Tiling:
        """About ``extent.n / TILE`` tiles, and ``least`` for parallelism, as far as the reach allows."""
        span, wide = [], []
        for lo, hi, r, length in zip(extent.low, extent.high, reach, wrap):
            if length is not None and r >= length / 2:
                raise ValueError(f"the largest separation {r} must be under half the box {length}")
            span.append(length if length is not None else max(hi - lo, 1e-90))
            wide.append(r * (1 + 1e-9) + 1e-14 * max(abs(lo), abs(hi), span[-1]))
        for times in WIDER:
            n = Tiling._cuts(span, [max(1, int(min(s / (times * r), 2**20))) for s, r in zip(span, wide)], float(max(least, extent.n / TILE)))
            found = Tiling(extent.low, tuple(s / k for s, k in zip(span, n)), tuple(n), tuple(wrap), tuple(wide))
            if extent.n / math.prod(n) * (1 + found.copies() / 2) <= ROWS and math.prod(n) >= least:
                break
        return found

    def copies(self) -> float:
        """Copies that a point has on average, to all neighbours."""
        return math.prod(1 + 2 * r / s for s, r, k in zip(self.size, self.reach, self.n) if k > 1) - 1

    def boxes(self, n: int, most: int) -> list[Box]:
        """All tiles in at most ``most`` boxes, none with more than a part in ``n`` of them where that can be."""
        most = max(1, min(most, MOST_ROUNDS))
        ways = [(i, j, k) for i in range(1, most + 1) for j in range(1, most // i + 1) for k in range(1, most // (i * j) + 1) if i <= self.n[0] and j <= self.n[1] and k <= self.n[2]]
        cuts = min(ways, key=lambda way: (max(math.prod(-(-m // c) / m for m, c in zip(self.n, way)), 1 / n), math.prod(way)))
        axes = [[(i * m // c, (i + 1) * m // c) for i in range(c)] for m, c in zip(self.n, cuts)]
        return [Box(*zip(*found)) for found in itertools.product(*axes)]

    def needed(self, box: Box) -> str:
        """SQL for points of which the own tile or a copy is in the box; a few more pass."""
        tests = []
        for i, c in enumerate("xyz"):
            if box.last[i] - box.first[i] == self.n[i]:
                continue
            room = 1.01 * self.reach[i] + 1e-12 * (abs(self.origin[i]) + self.n[i] * self.size[i])
            start, length = self.origin[i] + box.first[i] * self.size[i] - room, (box.last[i] - box.first[i]) * self.size[i] + 2 * room
            if self.wrap[i] is None:
                tests.append(f"{c} BETWEEN {start!r}D AND {start + length!r}D")
            elif length < self.wrap[i]:
                tests.append(f"pmod({c} - ({start!r}D), {self.wrap[i]!r}D) <= {length!r}D")
        lost = " or ".join(f"{c} is null" for c in "xyz")
        return f"{lost} or ({' and '.join(tests)})" if tests else "true"

    def inside(self, tile: np.ndarray, box: Box) -> np.ndarray:
        """Whether tiles are in the box; tile -1, of points without a place, is in the first one."""
        place = tile // (self.n[1] * self.n[2]), tile // self.n[2] % self.n[1], tile % self.n[2]
        found = np.logical_and.reduce([(k >= lo) & (k < hi) for k, lo, hi in zip(place, box.first, box.last)])
        return np.where(tile < 0, box.first == (0, 0, 0), found)

    @staticmethod
    def _cuts(span: list[float], most: list[int], left: float) -> list[int]:
        """Tiles on each axis, at most ``most``, and about ``left`` in all."""
        n, open_, left = [1, 1, 1], [0, 1, 2], left
        # axes that can't take their share of cuts leave it to the others
        while open_ and left > 1:
            side = (math.prod(span[i] for i in open_) / left) ** (1 / len(open_))
            full = [i for i in open_ if span[i] / side >= most[i] or span[i] / side <= 1]
            if not full:
                for i in open_:
                    n[i] = min(most[i], max(1, round(span[i] / side)))
                break
            for i in full:
                n[i] = most[i] if span[i] / side >= most[i] else 1
                left /= n[i]
            open_ = [i for i in open_ if i not in full]
        return n

    def _axis(self, c: str, i: int) -> list[str]:
        """SQL for the number of the tile, and for whether the neighbour below or above is in reach."""
        v = f"({c} - {self.origin[i]!r}D)"
        if self.wrap[i] is not None:
            v = f"pmod({v}, {self.wrap[i]!r}D)"
        k, size, reach = f"greatest(0, least({self.n[i] - 1}, int(floor({v} / {self.size[i]!r}D))))", self.size[i], self.reach[i]
        below, above = f"{v} - {k} * {size!r}D <= {reach!r}D", f"{v} - {k} * {size!r}D >= {size - reach!r}D"
        if self.wrap[i] is None:
            below, above = f"{below} and {k} > 0", f"{above} and {k} < {self.n[i] - 1}"
        return [f"{k} AS __k{i}", f"{below} AS __a{i}", f"{above} AS __b{i}"]

    def places(self, x: np.ndarray, copies: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``dealt`` of points in an array: the place of each row's point, its tile and its shift."""
        lost = np.isnan(x).any(axis=0)
        k, near = [], []
        for i, c in enumerate(x):
            v = np.where(lost, 0.0, c - self.origin[i])
            if self.wrap[i] is not None:
                v = np.mod(v, self.wrap[i])
            tile = np.clip(np.floor(v / self.size[i]), 0, self.n[i] - 1).astype(np.int64)
            v -= tile * self.size[i]
            below, above = v <= self.reach[i], v >= self.size[i] - self.reach[i]
            if self.wrap[i] is None:
                below, above = below & (tile > 0), above & (tile < self.n[i] - 1)
            k.append(tile)
            near.append({-1: below & ~lost, 1: above & ~lost})
        found = []
        for way in itertools.product((-1, 0, 1), repeat=3):
            if way != (0, 0, 0) and not (copies == "all" or (copies == "half" and way < (0, 0, 0))):
                continue
            reached = [near[i][d] for i, d in enumerate(way) if d]
            at = np.flatnonzero(np.logical_and.reduce(reached)) if reached else np.arange(x.shape[1])
            key = np.zeros(len(at), np.int64)
            for i, d in enumerate(way):
                key = key * self.n[i] + (k[i][at] + d) % self.n[i]
            if not reached:
                key[lost] = -1
            found.append((at, key, np.full(len(at), sum((d + 1) * 3 ** (2 - i) for i, d in enumerate(way)))))
        return tuple(np.concatenate(v) for v in zip(*found))

    def dealt(self, points: DataFrame, columns: list[str], copies: str) -> DataFrame:
        """``tile, shift`` and the columns: a row for the own tile (shift 13) and for each copy.

        ``copies``: ``none``, ``half`` (to one of two opposite neighbours) or ``all``.
        The shift has three digits to the base 3, for each axis the way from the
        own tile to that of the copy.
        """
        placed = points.selectExpr(*columns, *[e for i, c in enumerate("xyz") for e in self._axis(c, i)])
        targets = []
        for way in itertools.product((-1, 0, 1), repeat=3):
            if way != (0, 0, 0) and not (copies == "all" or (copies == "half" and way < (0, 0, 0))):
                continue
            key = "0L"
            for i, d in enumerate(way):
                key = f"({key} * {self.n[i]} + {f'pmod(__k{i} + {d}, {self.n[i]})' if d else f'__k{i}'})"
            reached = " and ".join(f"__{'a' if d < 0 else 'b'}{i}" for i, d in enumerate(way) if d)
            shift = sum((d + 1) * 3 ** (2 - i) for i, d in enumerate(way))
            made = f"struct({key} AS tile, {shift} AS shift)"
            targets.append(f"if({reached}, {made}, null)" if reached else made)
        # nulls go after the explode, which compiled code does faster than a filter of the array
        return placed.selectExpr(*columns, f"explode(array({', '.join(targets)})) AS t").where("t is not null").selectExpr("t.tile", "t.shift", *columns)


def chunk_size(n: int, cores: int) -> int:
    """Points of a chunk, so that one tile of all ``n`` points makes some groups for each core."""
    return min(CHUNK, max(LEAST_CHUNK, math.ceil(n / (4 * math.sqrt(cores)))))


SCHEMA = "tile long, i int, j int, data binary"


def packed_rows(head: np.ndarray, body: np.ndarray) -> pa.RecordBatch:
    """``tile, i, j, data``, one row for all points of a group: ``head`` is tile, i, j, role and shift of points, ``body`` their doubles."""
    order = np.lexsort(head[::-1])
    head = head[:, order]
    first = np.flatnonzero(np.r_[True, (head[:3, 1:] != head[:3, :-1]).any(axis=0)])
    code = (head[3] * 27 + head[4]).astype(np.uint8)
    # for each column the first bytes of all points, then the second ones
    found = [(code[p:q], np.ascontiguousarray(body[:, order[p:q]]).view(np.uint8).reshape(len(body), q - p, 8).transpose(0, 2, 1)) for p, q in zip(first, np.r_[first[1:], len(order)])]
    data = pa.array([c.tobytes() + v.tobytes() for c, v in found], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(head[0, first]), *(pa.array(v[first].astype(np.int32)) for v in head[1:3]), data], names=["tile", "i", "j", "data"])


def columns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of about ``PACKED`` rows at a time; nulls are NaN, in whole numbers -1."""

    def arrays(held: list[pa.RecordBatch]) -> list[np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        return [(c if pa.types.is_floating(c.type) else c.fill_null(-1)).to_numpy() for c in table.columns]

    held, rows = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= PACKED:
            yield arrays(held)
            held, rows = [], 0
    if rows:
        yield arrays(held)


def _sets(a: DataFrame, b: DataFrame | None) -> list[tuple[DataFrame, int, str]]:
    """Sets with the role of their points and the copies that they need."""
    return [(a, LEFT, "half" if b is None else "none"), *([] if b is None else [(b, OTHER, "all")])]


def hot_tiles(tiling: Tiling, a: DataFrame, b: DataFrame | None, n: int, chunk: int) -> np.ndarray:
    """Tiles with more than ``chunk`` points or copies, and into how many chunks either are cut: three rows, by a pass of its own."""
    if n <= chunk:
        return np.zeros((3, 0), np.int64)

    def sizes(own: int, copies: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, 0), np.int64)
            for xyz in columns_of(batches):
                _, tile, shift = tiling.places(np.stack(xyz), copies)
                left = (shift == 13) & (own == LEFT)
                tiles, at = np.unique(np.r_[total[0], tile], return_inverse=True)
                now = [np.bincount(at, np.r_[t, v], len(tiles)) for t, v in zip(total[1:], (left, ~left))]
                total = np.stack([tiles, *now]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, total)), names=["tile", "lefts", "others"])

        return run

    found = None
    for points, own, copies in _sets(a, b):
        part = points.select("x", "y", "z").mapInArrow(sizes(own, copies), "tile long, lefts long, others long")
        found = part if found is None else found.unionByName(part)
    parts = [f"int(ceil(greatest(sum({c}), 1) / {chunk})) AS {c}" for c in ("lefts", "others")]
    rows = found.groupBy("tile").agg(*map(F.expr, parts)).where("lefts > 1 or others > 1").collect()
    return np.array(sorted(map(tuple, rows)), np.int64).reshape(-1, 3).T


def packed_groups(tiling: Tiling, a: DataFrame, b: DataFrame | None, columns: list[str], n: int, partitions: int, chunk: int, hot: np.ndarray | None = None, box: Box | None = None) -> DataFrame:
    """The groups of ``groups`` as rows of ``packed_rows``, dealt in NumPy.

    ``hot`` is of ``hot_tiles``, which ``BROADCAST`` bounds.  A point without a
    place (a null coordinate) is in tile -1.
    """
    one_set = b is None
    hot = hot_tiles(tiling, a, b, n, chunk) if hot is None else hot

    def dealer(own: int, copies: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for *values, ids in columns_of(batches):
                body = np.stack(values)
                at, tile, shift = tiling.places(body[:3], copies)
                if box:
                    kept = np.flatnonzero(tiling.inside(tile, box))
                    if not len(kept):
                        continue
                    at, tile, shift = at[kept], tile[kept], shift[kept]
                role = np.where(shift == 13, own, OTHER)
                head = np.stack([tile, np.zeros_like(tile), np.zeros_like(tile), role, shift])
                if hot.shape[1]:
                    head, at = chunks(head, at, ids, hot, one_set)
                yield packed_rows(head, body[:, at])

        return run

    dealt = None
    for points, own, copies in _sets(a, b):
        found = points.where(tiling.needed(box)) if box else points
        part = found.select(*columns, "id").mapInArrow(dealer(own, copies), SCHEMA)
        dealt = part if dealt is None else dealt.unionByName(part)
    return dealt.repartition(partitions, "tile", "i", "j").sortWithinPartitions("tile", "i", "j")


def chunks(head: np.ndarray, at: np.ndarray, ids: np.ndarray, hot: np.ndarray, one_set: bool) -> tuple[np.ndarray, np.ndarray]:
    """``head`` and the places ``at`` of its points with points of hot tiles once for each pair of chunks that they are in."""
    place = np.minimum(np.searchsorted(hot[0], head[0]), hot.shape[1] - 1)
    is_hot = hot[0, place] == head[0]
    rest, some, place = np.flatnonzero(~is_hot), np.flatnonzero(is_hot), place[is_hot]
    lefts, others, left = hot[1, place], hot[2, place], head[3, some] == LEFT
    mixed = ids[at[some]].astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    c = (mixed % np.where(left, lefts, others).astype(np.uint64)).astype(np.int64)
    # a left chunk meets every chunk of copies, and as right points the left ones of later chunks of its own set
    met = np.maximum(lefts, others) if one_set else others
    times = np.where(left, met + (c if one_set else 0), lefts)
    row = np.repeat(np.arange(len(some)), times)
    k = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    some, left, met, c = some[row], left[row], met[row], c[row]
    spread = head[:, some]
    spread[1] = np.where(left, np.where(k < met, c, k - met), k)
    spread[2] = np.where(left & (k < met), k, c)
    spread[3] = np.where(left & (k >= met), RIGHT, spread[3])
    return np.concatenate([head[:, rest], spread], axis=1), np.r_[at[rest], at[some]]


def unpack(data: bytes, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Roles, shifts and doubles (columns, points) of a row of ``packed_rows``."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw) // (1 + 8 * columns)
    role, shift = np.divmod(raw[:n], 27)
    return role, shift, np.ascontiguousarray(raw[n:].reshape(columns, 8, n).transpose(0, 2, 1)).view(float)[..., 0]


def groups(tiling: Tiling, a: DataFrame, b: DataFrame | None, columns: list[str], n: int, partitions: int, chunk: int | None = None, box: Box | None = None) -> DataFrame:
    """``tile, i, j, role, shift`` and the columns, dealt and sorted by group ``(tile, i, j)``.

    ``n`` is the number of points of both sets.  With a box, its tiles alone.
    """
    chunk = chunk or CHUNK
    if box:
        a, b = (None if points is None else points.where(tiling.needed(box)) for points in (a, b))
    carried = [*columns, "id"]
    if b is None:
        rows = tiling.dealt(a, carried, "half").selectExpr("*", f"if(shift = 13, {LEFT}, {OTHER}) AS role")
    else:
        rows = tiling.dealt(a, carried, "none").selectExpr("*", f"{LEFT} AS role").unionByName(tiling.dealt(b, carried, "all").selectExpr("*", f"{OTHER} AS role"))
    if box:
        place = f"tile div {tiling.n[1] * tiling.n[2]}", f"tile div {tiling.n[2]} % {tiling.n[1]}", f"tile % {tiling.n[2]}"
        rows = rows.where(" and ".join(f"{k} >= {lo} and {k} < {hi}" for k, lo, hi in zip(place, box.first, box.last)))
    if n <= chunk:
        split = rows.selectExpr("tile", "0 AS i", "0 AS j", "role", "shift", *columns)
    else:
        parts = [f"int(ceil(greatest(count_if(role = {r}), 1) / {chunk})) AS {name}" for r, name in ((LEFT, "lefts"), (OTHER, "others"))]
        hot = rows.groupBy("tile").agg(*map(F.expr, parts)).where("lefts > 1 or others > 1")
        # at most so many points for each, counting copies, make a tile hot
        marked = rows.join(F.broadcast(hot) if 27 * n / chunk <= BROADCAST else hot, "tile", "left")
        marked = marked.selectExpr("tile", "shift", "role", *columns, "id", "coalesce(lefts, 1) AS lefts", "coalesce(others, 1) AS others")
        marked = marked.selectExpr("tile", "shift", "role", *columns, "lefts", "others", f"int(pmod(xxhash64(id), if(role = {LEFT}, lefts, others))) AS c")
        # a left chunk meets every chunk of copies, and as right points the left ones of later chunks of its own set
        to_left, itself = ("greatest(lefts, others)", "c") if b is None else ("others", "0")
        spread = marked.selectExpr("*", f"{to_left} AS met", f"explode(sequence(0, if(role = {LEFT}, {to_left} + {itself}, lefts) - 1)) AS k")
        is_left = f"role = {LEFT} and k < met"
        split = spread.selectExpr("tile", f"if({is_left}, c, if(role = {LEFT}, k - met, k)) AS i", f"if({is_left}, k, c) AS j", f"if(role = {LEFT} and k >= met, {RIGHT}, role) AS role", "shift", *columns)
    return split.repartition(partitions, "tile", "i", "j").sortWithinPartitions("tile", "i", "j")

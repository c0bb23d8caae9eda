"""Near-duplicate vectors through a pivot-permutation index (operator 10).

Every vector is described by its nearest of a set of reference vectors, the
pivots.  Vectors within the angle share most of them, so the inverted lists are
kept by pairs of pivots: two vectors meet if they share two or more, in the list
of the two least pivots that they share.  A list over ``group_rows`` is cut into
chunks and its pairs of chunks are dealt apart.

Lists hold ids, the pivots below and signs of random projections.  Signs that
differ in far more places than those of vectors at the angle do, tell most chance
meetings.  Only what is left takes its vectors along, and each pair is verified by
its cosine in double precision.

Lists send back, for each vector, how many it links with and one link of a
spanning forest, not the pairs.  Equal vectors are one node throughout.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyfield.llm.arrowio import slices
from tallyfield.llm.graph import components
from tallyfield.llm.shared import written
from tallyfield.llm.sieve import Sieve
from tallyfield.llm.simhash import forest

#: Pivots that describe a vector, and how many of them a pair must share to be verified.
NEAREST, SHARED = 6, 2
#: Pivots at most: the sample the index is fitted on.
PIVOTS = 4096
#: Signs of a vector, and by how many deviations more than those of vectors at the angle they may differ: a pair in three million is lost.
SIGNS, DEVIATIONS = 128, 5.0
#: Lists over ``group_rows`` up to which their sizes are broadcast, 12 bytes each; there are fewer than entries over ``group_rows``.
BROADCAST = 1_000_000
#: Pairs and rows that a task holds at a time.
PAIRS, ROWS = 1 << 20, 20_000

_PAIRS = np.array(list(itertools.combinations(range(NEAREST), SHARED)))
#: Bits of a pivot, one more than its number, in the packed pivots below a list's second one.
_BITS = 13


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of one length as doubles; with ``width``, cut or filled with zeros to it."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if width is None:
        return flat.reshape(len(sizes), -1)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = place < width
    out[row[inside], place[inside]] = flat[inside]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares can't overflow or vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pivot_count(n: int) -> int:
    """A power of two from twice the square root of the number of vectors up, from 64 to ``PIVOTS``.

    Then there are many more pairs of pivots than vectors, and lists are short.
    """
    return int(min(PIVOTS, max(64, 2 ** np.ceil(np.log2(2 * max(1, n) ** 0.5)))))


def apart_from_each_other(x: np.ndarray, least: float, n: int) -> np.ndarray:
    """The first ``n`` rows of unit vectors, those left out that have a cosine of ``least`` or more with one before.

    Several pivots within one cluster would describe its vectors by chance.
    """
    kept = np.ones(len(x), bool)
    for i in range(0, len(x), 512):
        block = x[i : i + 512]
        kept[i : i + 512] &= ~((block @ x[:i][kept[:i]].T >= least).any(axis=1))
        close = np.triu(block @ block.T >= least, 1)
        for k in np.flatnonzero(close.any(axis=1)):
            if kept[i + k]:
                kept[i : i + 512] &= ~close[k]
    return x[kept][:n]


def _described(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``node, vec_id, near, s0, s1``: the nearest pivots of each of ``vectors(node, vec_id, e)``, rising, and its signs."""
    planes = np.random.default_rng(42).normal(size=(SIGNS, pivots.shape[1]))

    def run(batches):
        for b in slices(batches, 4096):
            x = _matrix(b.column(2), pivots.shape[1])
            k = min(NEAREST, len(pivots))
            near = np.sort(np.argpartition(-(x @ pivots.T), k - 1, axis=1)[:, :k], axis=1).astype(np.int32)
            signs = np.packbits(x @ planes.T > 0, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), k).cast(pa.list_(pa.int32())), pa.array(signs[:, 0].copy()), pa.array(signs[:, 1].copy())], names=["node", "vec_id", "near", "s0", "s1"])

    return vectors.select("node", "vec_id", "e").mapInArrow(run, "node long, vec_id long, near array<int>, s0 long, s1 long")


def _listed(nodes: DataFrame) -> DataFrame:
    """``node, key, below, s0, s1``: a row for each pair of near pivots; ``below`` has the others under the second."""

    def run(batches):
        for b in slices(batches, 2048):
            p = _matrix(b.column(1)).astype(np.int64)
            pairs = _PAIRS[(_PAIRS < p.shape[1]).all(axis=1)]
            below = np.zeros((len(p), len(pairs)), np.int64)
            for k, (i, j) in enumerate(pairs):
                for r in (r for r in range(j) if r != i):
                    below[:, k] = below[:, k] << _BITS | p[:, r] + 1
            key = p[:, pairs[:, 0]] * PIVOTS + p[:, pairs[:, 1]]
            node, s0, s1 = (np.repeat(b.column(i).to_numpy(), len(pairs)) for i in (0, 2, 3))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(key.ravel().astype(np.int32)), pa.array(below.ravel()), pa.array(s0), pa.array(s1)], names=["node", "key", "below", "s0", "s1"])

    return nodes.select("node", "near", "s0", "s1").mapInArrow(run, "node long, key int, below long, s0 long, s1 long")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether packed pivots have none in common."""
    out = np.ones(np.broadcast(a, b).shape, bool)
    mask = (1 << _BITS) - 1
    for i in range(NEAREST - SHARED):
        x = a >> i * _BITS & mask
        for j in range(NEAREST - SHARED):
            out &= (x != (b >> j * _BITS & mask)) | (x == 0)
    return out


def _meetings(size: np.ndarray, n_low: np.ndarray):
    """Places of pairs in rows of groups one after another, low ones first in each; all pairs of a group whose rows are all low."""
    first = np.cumsum(size) - size
    whole = n_low == size
    group = np.repeat(np.arange(len(size)), np.where(whole, size, n_low))
    place = np.arange(len(group)) - np.repeat(np.cumsum(np.where(whole, size, n_low)) - np.where(whole, size, n_low), np.where(whole, size, n_low))
    start = np.where(whole[group], place + 1, n_low[group])
    n, left, right = size[group] - start, first[group] + place, first[group] + start
    ends = np.cumsum(n)
    begin = 0
    while begin < len(n):
        done = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        k = n[begin:stop]
        yield np.repeat(left[begin:stop], k), np.arange(k.sum()) + np.repeat(right[begin:stop] - (ends[begin:stop] - k - done), k)
        begin = stop


def _candidates(lists: DataFrame, total: int, least: float, group_rows: int) -> DataFrame:
    """``node, key, below, i, j, low, high``: rows of lists that may have a link there, dealt by pairs of chunks."""
    parts = lists.groupBy("key").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("parts")).where("parts > 1")
    kept = lists.join(F.broadcast(parts) if total * len(_PAIRS) / group_rows <= BROADCAST else parts.hint("merge"), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    kept = kept.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = kept.select("node", "key", "below", "s0", "s1", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") <= F.col("other")).alias("low"), (F.col("part") >= F.col("other")).alias("high"), "node", "below", "s0", "s1")
    p = np.arccos(least) / np.pi
    most = SIGNS * p + DEVIATIONS * np.sqrt(SIGNS * p * (1 - p)) + 1

    def near(t: pa.Table) -> pa.RecordBatch:
        head = [t.column(c).to_numpy() for c in ("key", "i", "j")]
        edge = np.flatnonzero(np.r_[True, np.any([h[1:] != h[:-1] for h in head], axis=0)])
        size = np.diff(np.r_[edge, t.num_rows])
        low = t.column("low").to_numpy()
        below, s0, s1 = (t.column(c).to_numpy() for c in ("below", "s0", "s1"))
        found = np.zeros(t.num_rows, bool)
        for a, b in _meetings(size, np.add.reduceat(low.astype(np.int64), edge)):
            close = np.flatnonzero(np.bitwise_count((s0[a] ^ s0[b]).view(np.uint64)) + np.bitwise_count((s1[a] ^ s1[b]).view(np.uint64)) <= most)
            a, b = a[close], b[close]
            mine = _apart(below[a], below[b])
            found[a[mine]] = found[b[mine]] = True
        return t.filter(pa.array(found)).select(["node", "key", "below", "i", "j", "low", "high"]).combine_chunks().to_batches()

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < ROWS:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            head = [t.column(c).to_numpy() for c in ("key", "i", "j")]
            whole = int(np.flatnonzero(np.any([h != h[-1] for h in head], axis=0))[-1:].sum() + 1) if any((h != h[-1]).any() for h in head) else 0
            if whole:  # the last group may go on in the next batch
                yield from near(t.slice(0, whole).combine_chunks())
            held, rows = t.slice(whole).to_batches(), t.num_rows - whole
        if rows:
            yield from near(pa.Table.from_batches(held).combine_chunks())

    order = ["key", "i", "j"]
    return dealt.repartition(*order).sortWithinPartitions(*order, F.desc("low")).mapInArrow(run, "node long, key int, below long, i int, j int, low boolean, high boolean")


def node_links(nodes: DataFrame, vectors: DataFrame, total: int, one_list: bool, least: float = 0.95, group_rows: int = 512) -> DataFrame:
    """``node, n, root``: what each list found. ``n`` counts links by their ``m``; ``root`` is a node in one component.

    ``nodes(node, m, near, s0, s1)`` are described vectors, ``vectors(node, e)`` are read for candidates.
    ``one_list``: the few vectors that there are all meet.
    """
    lists = _listed(nodes)
    if one_list:
        lists = nodes.select("node", F.lit(-1).alias("key"), F.lit(0).cast("long").alias("below"), "s0", "s1")
    left = written(_candidates(lists, total, least, group_rows), "candidates")
    sieve = Sieve.of(left.select("node").distinct(), "node")

    def passing(batches):
        for b in batches:
            yield b.filter(pa.array(sieve.passes(b.column(0).to_numpy())))

    wanted = vectors.select("node", "e").mapInArrow(passing, "node long, e array<float>").dropDuplicates(["node"])
    full = left.join(wanted.hint("merge"), "node").join(nodes.select("node", "m").hint("merge"), "node").select("key", "i", "j", F.size("e").alias("d"), "node", "m", "low", "high", "below", "e")

    def verified(b: pa.Table) -> pa.RecordBatch | None:
        node, m, low, high, below = (b.column(c).to_numpy() for c in ("node", "m", "low", "high", "below"))
        if len(node) < 2:
            return None
        x = _unit(_matrix(b.column("e").combine_chunks()))
        lows, highs = np.flatnonzero(low), np.flatnonzero(high)
        n, links = np.zeros(len(node), np.int64), []
        for c in range(0, len(lows), 256):
            a = lows[c : c + 256]
            p, q = np.nonzero(x[a] @ x[highs].T >= least - 1e-9)
            p, q = a[p], highs[q]
            mine = (node[p] != node[q]) & _apart(below[p], below[q])
            p, q = p[mine], q[mine]
            near_enough = np.einsum("ij,ij->i", x[p], x[q]) >= least
            p, q = p[near_enough], q[near_enough]
            np.add.at(n, p, m[q])
            if not (low & high).all():
                np.add.at(n, q, m[p])
            links.append((p, q))
        met = np.flatnonzero(n)
        if not len(met):
            return None
        root = forest(len(node), iter(links))
        return pa.RecordBatch.from_arrays([pa.array(node[met]), pa.array(n[met]), pa.array(node[root[met]])], names=["node", "n", "root"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            heads = list(zip(*(b.column(i).to_pylist() for i in range(4))))
            start = 0
            for i, head in enumerate(heads):
                if last is not None and head != last:
                    held.append(b.slice(start, i - start))
                    if (done := verified(pa.Table.from_batches(held))) is not None:
                        yield done
                    held, start = [], i
                last = head
            held.append(b.slice(start))
        if last is not None and (done := verified(pa.Table.from_batches(held))) is not None:
            yield done

    order = ["key", "i", "j", "d"]
    return full.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "node long, n long, root long")


def near_vectors(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", *, least: float = 0.95, group_rows: int = 512) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, a row for each row of ``vectors``.

    Links join vectors of one length at a cosine of ``least`` or more.  Null,
    empty and zero vectors, and those with null or non-finite components, link
    with nothing and are components of their own.  Rows that share a ``vec_id``
    are nodes of their own; a component without an id has a null id, and ``kept``
    then is true.  Other columns aren't read.
    """
    e = F.transform(vector, lambda v: v + F.lit(0).cast("float"))  # one zero
    sound = F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(vector, lambda v: v != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(F.coalesce(sound, F.lit(False)), e).alias("e")).withColumn("node", F.when(F.col("e").isNotNull(), F.xxhash64("e")))
    good = rows.where("node is not null")
    total, distinct = good.agg(F.count("*"), F.approx_count_distinct("node")).first()
    # a few times the pivots by hash, and of those twice the pivots, so that neither copies nor all vectors meet
    mark = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 8 * pivot_count(total) / max(1, distinct)))
    sample = good.where(mark).select("node", "e").dropDuplicates(["node"]).orderBy(F.xxhash64("node"), "node").limit(2 * pivot_count(total)).select("e").collect()
    if not sample:
        component = F.col("vec_id")
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), component.alias("component_id"), F.lit(True).alias("kept"))
    width = max(len(r.e) for r in sample)
    pivots = apart_from_each_other(_unit(np.array([[*r.e, *[0.0] * (width - len(r.e))] for r in sample], float)), least, pivot_count(total))
    nodes = _described(good, pivots).groupBy("node").agg(F.count("*").alias("m"), F.min("vec_id").alias("first"), F.first(F.struct("near", "s0", "s1")).alias("d")).select("node", "m", "first", "d.*")
    nodes = written(nodes, "vectors")
    found = written(node_links(nodes, good, total, len(pivots) <= 2 * NEAREST, least, group_rows), "links")
    counted = found.groupBy("node").agg(F.sum("n").alias("n"))
    rooted = nodes.select("node", "m", "first").join(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_id = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(least_id, "root").join(counted, "node", "left").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    out = rows.select("vec_id", "node").join(of, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))

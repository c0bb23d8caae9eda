"""Removal of repeated byte strings with longest-previous-factor arrays (operator 9).

A string of ``length`` bytes that starts at two places is a repeated window.
Windows are dealt by their minimizer, the k-gram of least hash among their
k-grams: equal windows have equal minimizers at equal places.  Successive
windows with one minimizer make a stretch, so a text gives a stretch for about
every 170 bytes, and only hashes of it at first.

1. A minimizer met once has no repeated window and goes.  Where all stretches of
   a minimizer are equal, all their windows repeat.
2. For the rest one stretch of each kind is read.  Sorted by what follows the
   minimizer, and by what goes before it backwards, each learns how far it can
   agree with any other; beyond that it is cut off.  What is left of different
   stretches is mostly equal, so it is merged again, and groups become small
   even where a passage stands in a third of all texts.
3. In each group a suffix array, its longest common prefixes, and the previous
   and next smaller places in suffix order give the longest previous factor of
   each place; the mirror gives the longest later one.  Groups over ``group``
   strings are split before: equal windows have the minimizer at equal places, so
   pieces of the strings are dealt by those places and by what all windows there
   share, at last by single places.  Hashes deal; the arrays decide.

Intervals go back from groups to stretches to texts.  Equal texts are one text
throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tallyfield.llm.arrowio import slices
from tallyfield.llm.shared import written
from tallyfield.llm.sieve import Sieve

#: Bytes of a k-gram.
K = 64
#: Bytes that are hashed at a time; places within them take 24 bits.
BLOCK = 4 << 20
#: Rows that a task sorts, and strings that it puts into arrays, on average.
TASK_ROWS, TASK_STRINGS = 25_000, 5_000
#: A stretch's place and its text's hash make one number by this factor.
_PLACE = 1_000_003


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each ``length`` bytes of ``data``, by doubling."""
    h, have, out, done = _BYTE[data], 1, None, 0
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    rest = length
    while rest:
        if rest & 1:
            part = h[done : done + n]
            out = part if out is None else out * np.uint64(0xD6E8FEB86659FD93) + part
            done += have
        rest >>= 1
        if rest:
            h = h[:-have] * np.uint64(0x9E3779B97F4A7C15 + 2 * have) + h[have:]
            have *= 2
    return _mixed(out)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if have < width else v


def stretches(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Stretches of one block: first window, number of windows, place of the minimizer, its hash."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h = window_hashes(data, K)
    low = np.uint64((1 << 24) - 1)
    least = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - K + 1)
    at = (least & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return first, np.diff(np.r_[first, len(at)]), at[first], h[at[first]]


def _blocks(n: int, length: int) -> Iterator[tuple[int, int]]:
    """Overlapping blocks such that each window is inside exactly one."""
    step = BLOCK - length + 1
    for i in range(0, max(1, n - length + 1), step):
        yield i, min(n, i + BLOCK)


def capped_lpf(codes: np.ndarray, valid: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix order of the ``valid`` places by their first ``cap`` bytes, and for each of
    ``valid`` the length of its longest previous and its longest later factor, up to ``cap``.

    All of ``valid`` must have ``cap`` bytes after them.
    """
    ranks, have = [codes.astype(np.int64)], 1
    while 2 * have <= cap:
        last = ranks[-1]
        pair = last[:-have] * (last.max() + 1) + last[have:]
        ranks.append(np.unique(pair, return_inverse=True)[1])
        have *= 2
    last = ranks[-1]
    whole = last[valid] * (last.max() + 1) + last[valid + cap - have]
    sa = np.argsort(whole, kind="stable")
    place = valid[sa]
    # longest common prefix of neighbours in suffix order, from the longest rank down
    lcp, a, b = np.zeros(len(sa), np.int64), place[:-1].copy(), place[1:].copy()
    same = whole[sa[1:]] == whole[sa[:-1]]
    found = np.where(same, cap, 0)
    left = np.flatnonzero(~same)
    for i in range(len(ranks) - 1, -1, -1):
        x, y = a[left], b[left]
        inside = (x < len(ranks[i])) & (y < len(ranks[i]))
        agree = np.zeros(len(left), bool)
        agree[inside] = ranks[i][x[inside]] == ranks[i][y[inside]]
        moved = left[agree]
        found[moved] += 1 << i
        a[moved] += 1 << i
        b[moved] += 1 << i
    lcp[1:] = np.minimum(found, cap)

    def nearest(order: np.ndarray, common: np.ndarray, smaller: bool) -> np.ndarray:
        """Common prefix with the previous place in suffix order that is smaller (or larger)."""
        n = len(order)
        to, shared = np.arange(-1, n - 1), common.copy()
        open_ = np.arange(n)
        while len(open_):
            t = to[open_]
            open_ = open_[t >= 0]
            t = to[open_]
            wrong = order[t] > order[open_] if smaller else order[t] < order[open_]
            open_, t = open_[wrong], t[wrong]
            shared[open_], to[open_] = np.minimum(shared[open_], shared[t]), to[t]
        shared[to < 0] = 0
        return shared

    back = np.r_[0, lcp[1:][::-1]]
    out = []
    for smaller in (True, False):
        best = np.maximum(nearest(place, lcp, smaller), nearest(place[::-1], back, smaller)[::-1])
        by_place = np.empty(len(sa), np.int64)
        by_place[sa] = best
        out.append(by_place)
    return sa, out[0], out[1]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true: (first, past the last)."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _stretch_rows(docs: DataFrame, length: int) -> DataFrame:
    """``m, c, t1, t2, start, windows, n, first``: stretches of each different text of ``docs(doc_id, text)``."""
    keyed = docs.select(*_text_key(F.col("text")), "doc_id", "text").where(F.octet_length("text") >= length)

    def run(batches):
        for b in slices(batches, 64):
            out = [[], [], [], [], [], [], []]
            for t1, t2, doc, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                raw = text.encode()
                data = np.frombuffer(raw, np.uint8)
                for lo, hi in _blocks(len(raw), length):
                    first, n, _, m = stretches(data[lo:hi], length)
                    first = first + lo
                    c = [xxhash.xxh3_64_intdigest(raw[s : s + k + length - 1]) for s, k in zip(first.tolist(), n.tolist())]
                    for column, values in zip(out, (m.view(np.int64), np.array(c, np.uint64).view(np.int64), np.full(len(n), t1), np.full(len(n), t2), first, n.astype(np.int32))):
                        column.append(values)
                    out[6] += [doc] * len(n)
            if out[6]:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in out[:6]), pa.array(out[6], pa.int64())], names=["m", "c", "t1", "t2", "start", "windows", "doc_id"])

    rows = keyed.mapInArrow(run, "m long, c long, t1 long, t2 long, start long, windows int, doc_id long")
    return rows.groupBy("m", "c", "t1", "t2", "start", "windows").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def _cut_parts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``m, c, before, after`` of one stretch of each kind: what goes before the minimizer, backwards, and the rest.

    Texts and stretches that aren't wanted are told by bitmaps, so whole texts
    aren't shuffled; the few let through by chance go where kinds are joined.
    """
    texts = Sieve.of(wanted.select("t1").distinct(), "t1")
    places = Sieve.of(wanted.selectExpr(f"t1 ^ (start * {_PLACE}L) AS p"), "p")
    keyed = docs.select(F.xxhash64("text").alias("t1"), "text").where(F.octet_length("text") >= length)

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(texts.passes(b.column(0).to_numpy())))
            for b in slices([b], 64):
                out = [[], [], [], []]
                for t1, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    raw = text.encode()
                    data = np.frombuffer(raw, np.uint8)
                    for lo, hi in _blocks(len(raw), length):
                        first, n, at, m = stretches(data[lo:hi], length)
                        keep = np.flatnonzero(places.passes(np.int64(t1) ^ ((first + lo) * _PLACE)))
                        for s, k, a, h in zip((first[keep] + lo).tolist(), n[keep].tolist(), (at[keep] + lo).tolist(), m[keep].view(np.int64).tolist()):
                            part = raw[s : s + k + length - 1]
                            c = xxhash.xxh3_64_intdigest(part)
                            for column, value in zip(out, (h, c - (1 << 64) if c >> 63 else c, part[: a - s][::-1], part[a - s :])):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["m", "c", "before", "after"])

    return keyed.mapInArrow(run, "m long, c long, before binary, after binary").dropDuplicates(["m", "c"])


def _reach(parts: DataFrame, side: str, tasks: int) -> DataFrame:
    """``m, c, side, full``: the side, forwards, cut to what it shares with another of its minimizer at most, and its size before.

    The sorted rows are dealt by range, so no group is one task's; the range needs a
    hundred rows of each task on the driver, and ``tasks`` follows the rows.  The first and
    last row of a task don't see their neighbours beyond and stay whole; what is
    left on too long a row costs later work only.
    """
    way = -1 if side == "before" else 1
    ordered = parts.select("m", side, "c").repartitionByRange(tasks, "m", side, "c").sortWithinPartitions("m", side, "c")

    def run(batches):
        held = None  # m, side, c, reach so far

        def rows(done):
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()), pa.array([d[1][: d[3]][::way] for d in done], pa.binary()), pa.array([len(d[1]) for d in done], pa.int32())], names=["m", "c", side, "full"])

        for b in slices(batches, 4096):
            done = []
            for m, s, c in zip(*(b.column(i).to_pylist() for i in range(3))):
                if held is None:
                    held = [m, s, c, len(s)]
                    continue
                shared = _common(held[1], s) if held[0] == m else 0
                held[3] = max(held[3], shared)
                done.append(held)
                held = [m, s, c, shared]
            yield rows(done)
        if held:
            yield rows([[held[0], held[1], held[2], len(held[1])]])

    return ordered.mapInArrow(run, f"m long, c long, {side} binary, full int")


def _repeats_by_suffixes(groups: DataFrame, length: int) -> DataFrame:
    """``m, t, repeated, later``: runs of windows in ``groups(m, t, s, n, doc, at)`` that stand elsewhere, and that stand earlier."""

    def found(rows: list[tuple]) -> pa.RecordBatch:
        out = [[], [], [], []]
        rows.sort(key=lambda r: (r[0], r[4], r[5], r[1]))
        size = np.array([len(r[2]) for r in rows])
        begin = np.r_[0, np.cumsum(size + 1)[:-1]]
        codes = np.frombuffer(b"\0".join(r[2] for r in rows), np.uint8)
        windows = size - length + 1
        at = np.repeat(begin, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        # equal windows have equal minimizers, so other groups in the array don't disturb
        _, previous, following = capped_lpf(codes, at, length)
        edge = np.r_[0, np.cumsum(windows)]
        for i, r in enumerate(rows):
            cut = slice(edge[i], edge[i + 1])
            later = previous[cut] >= length
            for column, value in zip(out, (r[0], r[1], _runs(later | (following[cut] >= length) | (r[3] > 1)), _runs(later))):
                column.append(value)
        runs = pa.list_(pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], runs), pa.array(out[3], runs)], names=["m", "t", "repeated", "later"])

    def run(batches):
        held: list[tuple] = []
        size = 0
        for b in slices(batches, 1024):
            for r in zip(*(b.column(i).to_pylist() for i in range(6))):
                if size > 1 << 20 and r[0] != held[-1][0]:
                    yield found(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[2])
        if held:
            yield found(held)

    tasks = max(groups.sparkSession.sparkContext.defaultParallelism, -(-groups.count() // TASK_STRINGS))
    return groups.select("m", "t", "s", "n", "doc", "at").repartition(tasks, "m").sortWithinPartitions("m").mapInArrow(run, "m long, t long, repeated array<array<int>>, later array<array<int>>")


def _pieces(groups: DataFrame, length: int, width: int) -> DataFrame:
    """``m, t, lo, g, q, s, mid, n, doc, at``: the strings' pieces for each ``width`` places of a window around the minimizer.

    Windows that have the minimizer at one of those places share a core.  Equal
    windows have equal minimizers at equal places, hence equal cores, so pieces
    are dealt by minimizer, places and core.
    """

    def run(batches):
        for b in slices(batches, 64):
            out = [[] for _ in range(10)]
            for m, t, s, mid, n, doc, at in zip(*(b.column(i).to_pylist() for i in range(7))):
                last = len(s) - length  # of the windows' places in s
                for block in range(max(0, mid - last) // width, mid // width + 1):
                    near, far = block * width, block * width + width - 1
                    lo, hi = max(0, mid - far), min(last, mid - near)
                    if lo > hi:
                        continue
                    piece = s[lo : hi + length]
                    g = xxhash.xxh3_64_intdigest(s[mid - near : mid - far + length], (m ^ block) % 2**64)
                    for column, value in zip(out, (m, t, lo, g, xxhash.xxh3_64_intdigest(piece), piece, mid - lo, n, doc, at)):
                        column.append(value)
            hashes = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([hashes(v) if i in (3, 4) else pa.array(v, pa.binary() if i == 5 else pa.int64()) for i, v in enumerate(out)], names=["m", "t", "lo", "g", "q", "s", "mid", "n", "doc", "at"])

    return groups.select("m", "t", "s", "mid", "n", "doc", "at").mapInArrow(run, "m long, t long, lo long, g long, q long, s binary, mid long, n long, doc long, at long")


def _grouped(strings: DataFrame) -> DataFrame:
    """Distinct ``m, mid, t, s`` with the number and the first place of each, and the size of their group, where anything can repeat."""
    distinct = strings.groupBy("m", "mid", "t", "s").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "at")).alias("e")).select("m", "mid", "t", "s", "n", "e.doc", "e.at")
    sizes = distinct.groupBy("m").agg(F.count("*").alias("size"), F.max("n").alias("most")).where("size > 1 or most > 1").select("m", "size")
    return written(distinct.join(sizes.hint("merge"), "m"), "strings")


def _repeats(groups: DataFrame, length: int, group: int, widths: tuple[int, ...] = (16, 1)) -> DataFrame:
    """``m, t, repeated, later, e_doc, e_at`` of ``groups``; those over ``group`` strings are split by pieces first, again and again.

    Pieces of one place are equal in a group of theirs, so the last split leaves
    one string, whatever the number of texts that hold it.
    """
    found = _repeats_by_suffixes(groups.where(F.col("size") <= group) if widths else groups, length)
    found = found.join(groups.select("m", "t", F.col("doc").alias("e_doc"), F.col("at").alias("e_at")).hint("merge"), ["m", "t"])
    large = groups.where(F.col("size") > group)
    if not widths or large.isEmpty():
        return found
    pieces = written(_pieces(large, length, widths[0]), "pieces")
    smaller = _grouped(pieces.select(F.col("g").alias("m"), "mid", F.col("q").alias("t"), "s", "n", "doc", "at"))
    inner = written(_repeats(smaller, length, group, widths[1:]), "repeats").select(F.col("m").alias("g"), F.col("t").alias("q"), "repeated", "later", "e_doc", "e_at")
    moved = lambda runs: F.transform(runs, lambda r: F.array(r[0] + F.col("lo").cast("int"), r[1] + F.col("lo").cast("int")))
    holder = (F.col("doc") == F.col("e_doc")) & (F.col("at") == F.col("e_at"))
    met = pieces.select("m", "t", "lo", "g", "q", "doc", "at").join(inner.hint("merge"), ["g", "q"])
    met = met.select("m", "t", "doc", "at", moved(F.col("repeated")).alias("r"), moved(F.when(holder, F.col("later")).otherwise(F.col("repeated"))).alias("l"))
    split = met.groupBy("m", "t").agg(F.flatten(F.collect_list("r")).alias("repeated"), F.flatten(F.collect_list("l")).alias("later"), F.first("doc").alias("e_doc"), F.first("at").alias("e_at"))
    return found.unionByName(split)


def repeated_spans(docs: DataFrame, length: int = 400, keep_first: bool = False, group: int = 256) -> DataFrame:
    """``t1, t2, spans``: byte intervals of repeated strings, by key of the text of ``docs(doc_id, text)``.

    With ``keep_first`` the earliest place of each string (by document id and
    place) isn't among them; they then hold for the row of id ``first``, and other
    rows of the text repeat whole.
    """
    if length < 2 * K:
        raise ValueError(f"strings must have {2 * K} bytes at least")
    rows = written(_stretch_rows(docs, length), "stretches")
    by_m = rows.groupBy("m").agg(F.sum("n").alias("total"), (F.min("c") != F.max("c")).alias("several")).where("total > 1").select("m", "several")
    kinds = rows.groupBy("m", "c").agg(F.sum("n").alias("n"), F.min(F.struct(F.coalesce("first", F.lit(-(2**63))).alias("doc"), "start", "t1", "t2", "first", "windows")).alias("f"))
    kinds = written(kinds.join(by_m.hint("merge"), "m").select("m", "c", "n", "several", "f.*"), "kinds")
    parts = written(_cut_parts(docs, kinds.where("several"), length), "parts")
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-parts.count() // TASK_ROWS))
    reach = _reach(parts, "after", tasks).drop("full").join(_reach(parts, "before", tasks).hint("merge"), ["m", "c"]).where(F.octet_length("before") + F.octet_length("after") >= length)
    reach = reach.join(kinds.where("several").select("m", "c", "n", "doc", "start").hint("merge"), ["m", "c"])
    # ``at`` is the minimizer's place in the text, which cuts don't move
    reach = reach.select("m", "c", F.concat("before", "after").alias("s"), F.octet_length("before").cast("long").alias("mid"), (F.col("full") - F.octet_length("before")).alias("skip"), "n", "doc", (F.col("start") + F.col("full")).alias("at")).withColumn("t", F.xxhash64("s", "mid"))
    reach = written(reach, "reach")
    found = _repeats(_grouped(reach), length, group).where(F.size("repeated") > 0)
    of = reach.select("m", "c", "t", "skip", "doc", "at").join(found.hint("merge"), ["m", "t"])
    moved = lambda runs: F.transform(runs, lambda r: F.array(r[0] + F.col("skip"), r[1] + F.col("skip")))
    holder = (F.col("doc") == F.col("e_doc")) & (F.col("at") == F.col("e_at"))
    of = of.select("m", "c", moved(F.col("repeated")).alias("repeated"), moved(F.when(holder, F.col("later")).otherwise(F.col("repeated"))).alias("later"))

    every = F.array(F.array(F.lit(0), F.col("windows").cast("int")))
    none = F.array().cast("array<array<int>>")
    runs = kinds.join(of.hint("merge"), ["m", "c"], "left").withColumn("all", F.when(~F.col("several") | (F.col("n") > 1), every).otherwise(F.coalesce("repeated", none)))
    # written: a join of two tables can be split where one stretch stands in many texts
    runs = runs.select("m", "c", "all", F.coalesce("later", none).alias("own"), F.col("t1").alias("f1"), F.col("t2").alias("f2"), F.col("start").alias("f_start"))
    runs = written(runs.where((F.size("all") > 0) | (F.size("own") > 0)), "runs")
    is_first = (F.col("t1") == F.col("f1")) & (F.col("t2") == F.col("f2")) & (F.col("start") == F.col("f_start"))
    # a place that isn't the first of its kind repeats whole
    runs_here = F.when(is_first, F.col("own")).otherwise(every) if keep_first else F.col("all")
    # with ``keep_first`` a text of several rows is listed though its first row keeps all
    listed = (F.size("r") > 0) | (F.lit(keep_first) & (F.col("here") > 1))
    met = rows.select("m", "c", "t1", "t2", "start", "windows", "first", F.col("n").alias("here")).join(runs.hint("merge"), ["m", "c"]).withColumn("r", runs_here).where(listed)
    spans = F.transform("r", lambda x: F.struct((F.col("start") + x[0]).alias("a"), (F.col("start") + x[1] + (length - 1)).alias("b")))
    return met.groupBy("t1", "t2").agg(F.flatten(F.collect_list(spans)).alias("spans"), F.min("first").alias("first"))


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, keep: list[str], length: int = 400, keep_first: bool = False, group: int = 256, as_text: bool = False) -> DataFrame:
    """The ``keep`` columns with ``n_bytes, n_removed, n_spans, kept_sha256`` and ``kept`` (binary).

    A byte goes if a string of ``length`` bytes that covers it also starts
    anywhere else, in this or another text; with ``keep_first``, if it also
    starts earlier, by document id (nulls first) and place.  Matches are judged
    on the input and don't cross texts.  One row for each row of ``docs``; null
    counts as empty, and texts under ``length`` bytes stay as they are.  Rows
    with one id and one text keep alike.  ``kept`` need not be valid UTF-8; with
    ``as_text`` it is a string, without the bytes of characters that were cut.
    """
    if clash := {"n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"} & set(keep):
        raise ValueError(f"columns named as results: {sorted(clash)}")
    plain = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    # written: a join of two tables can be split where one text has many copies
    spans = written(repeated_spans(plain, length, keep_first, group), "spans")
    # one column for those that are kept, so that their names can't clash
    slim = docs.select(F.struct(*[docs[c] for c in keep]).alias("__row"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("__text"), docs[doc_id].cast("long").alias("__doc"))
    keyed = slim.select("*", *_text_key(F.col("__text"))).join(spans.hint("merge"), ["t1", "t2"], "left")
    again = F.lit(keep_first) & F.col("spans").isNotNull() & ~F.col("__doc").eqNullSafe(F.col("first"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.octet_length("__text").cast("long").alias("b")))
    ready = keyed.select("__row", "__text", F.when(again, whole).otherwise(F.col("spans")).alias("spans"))

    def run(batches):
        for b in slices(batches, 64):
            out = [[], [], [], [], []]
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = t.encode()
                cuts = _merged([(x["a"], x["b"]) for x in spans or []])
                ends = [0, *(x for c in cuts for x in c), len(raw)]
                kept = b"".join(raw[i:j] for i, j in zip(ends[::2], ends[1::2]))
                for column, value in zip(out, (len(raw), len(raw) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if as_text else kept)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if as_text else pa.binary())))], names=["__row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = slim.select("__row").schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("kept", "string" if as_text else "binary")):
        schema = schema.add(name, kind)
    return ready.mapInArrow(run, schema).select("__row.*", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")

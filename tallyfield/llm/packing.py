"""Packing token sequences by length patterns and non-negative least squares (operator 7).

Documents over the sequence length are cut into whole sequences and a first
piece, which may be shorter.  The histogram of piece lengths, at most as long as
a sequence, is all the driver sees.  On it, patterns of two or three lengths that
fill a sequence are enumerated; non-negative least squares fits how often to
repeat each so that the histogram is used up; counts are rounded down, and the
residual histogram is packed best fit, longest first.  Every step works on
lengths with their multiplicities, so its cost doesn't grow with the data.

The plan gives each length ranges of ranks, each with its sequences and offset.
Pieces get their rank within their length from counts by task and length, so no
length's pieces meet in one task.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from tallyfield.llm.arrowio import slices
from tallyfield.llm.bpe import byte_symbols, default_path
from tallyfield.llm.pretok import SPECIAL
from tallyfield.llm.shared import written

#: Patterns to fit, at most; the lengths of three-length patterns are thinned to that.
PATTERNS = 30_000
#: Parts of the fitted counts to try; the plan with the fewest sequences stays.
SCALES = (1.0, 0.95, 0.8, 0.5)


#: Fixed value: the public split rule of byte-level vocabularies, as the libraries write it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranked(path: str) -> dict[bytes, int] | None:
    """Tokens and their identifiers, if merging by least identifier is merging by rank; else None.

    That is so if the identifiers follow the merges, and each token alone merges
    to itself: then no other pair of tokens can ever stand in its place.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    byte_of = byte_symbols()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"].get(a + b) for a, b in merges]
    if None in ids or any(a >= b for a, b in zip(ids, ids[1:])) or any(model["vocab"].get(c, len(model["vocab"])) >= ids[0] for c in byte_of):
        return None
    return {bytes(byte_of[c] for c in t): model["vocab"][t] for t in [*byte_of, *(a + b for a, b in merges)]}


class Encoder:
    """Identifiers as native uint32 bytes (little-endian here), those of the ``tokenizers`` library.

    Whole texts go through ``tiktoken``, several times faster, over the same file's
    vocabulary where ``ranked`` has it, and through the library elsewhere, as do
    texts with the special string.  Nothing is kept from one text to the next.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer, ranks = Tokenizer.from_file(path), ranked(path)
        self.by_library = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
        self.plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ranks else self.by_library

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        return array("I", (self.by_library if SPECIAL in text else self.plain)(text)).tobytes()


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """Starts and lengths of the pieces of ``n`` tokens; only the first may be shorter than ``size`` where there are several."""
    first = n % size or size
    return [(0, first)] + [(i, size) for i in range(first, n, size)] if n > size else [(0, n)]


def _patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """Rows of three lengths that sum to ``size``, in falling order; 0 for none."""
    present = np.zeros(size + 1, bool)
    present[lengths] = True
    two = [(size - a, a, 0) for a in range(1, size // 2 + 1) if present[a] and present[size - a]]
    small = lengths[lengths <= size // 2]
    step = max(1, int(np.ceil(len(small) ** 2 / 4 / PATTERNS)))
    three = []
    for i, b in enumerate(small):
        c = small[: i + 1][(i % step) :: step]
        a = size - b - c
        ok = a >= b
        c, a = c[ok], a[ok]
        ok = present[a]
        three.append(np.c_[a[ok], np.full(ok.sum(), b), c[ok]])
    return np.concatenate([np.array(two, int).reshape(-1, 3), *three]) if len(two) or three else np.zeros((0, 3), int)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts of least squared error, by accelerated projected gradients."""
    h = counts.astype(float)
    h[0] = 0

    def used(x):
        out = np.zeros(len(h))
        for j in range(3):
            out += np.bincount(patterns[:, j], x, len(h))
        out[0] = 0
        return out

    def back(r):
        return r[patterns].sum(axis=1)

    v = np.ones(len(patterns))
    for _ in range(20):
        v = back(used(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y + back(h - used(y)) / norm)
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (was - 1) / t * (new - x)
        x = new
    return x


def _best_fit(counts: np.ndarray, size: int) -> Counter:
    """Patterns and how often, longest lengths first, each where least room is left."""
    rooms: list[Counter] = [Counter() for _ in range(size + 1)]
    free = np.zeros(size + 1, bool)

    def put(room: int, pattern: tuple, n: int) -> None:
        rooms[room][pattern] += n
        free[room] = True

    for length in range(size, 0, -1):
        n = int(counts[length])
        while n:
            fits = np.flatnonzero(free[length:])
            if len(fits):
                room = length + int(fits[0])
                pattern, have = next(iter(rooms[room].items()))
            else:
                room, pattern, have = size, (), n
            k = min(room // length, n)
            m = min(have, n // k)
            if len(fits):
                rooms[room][pattern] -= m
                if not rooms[room][pattern]:
                    del rooms[room][pattern]
                    free[room] = bool(rooms[room])
            put(room - k * length, pattern + (length,) * k, m)
            n -= m * k
    return sum(rooms, Counter())


def plan(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences have each; together they use up the histogram."""
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    full, counts[size] = int(counts[size]), 0
    lengths = np.flatnonzero(counts)
    patterns = _patterns(lengths, size)
    x = fit(patterns, counts) if len(patterns) else np.zeros(0)
    best: Counter | None = None
    for scale in SCALES:
        left, made = counts.copy(), Counter()
        for i in np.argsort(-x, kind="stable"):
            n = int(x[i] * scale)
            if not n:
                break
            p = Counter(int(v) for v in patterns[i] if v)
            n = min(n, *(int(left[v]) // k for v, k in p.items()))
            if n:
                made[tuple(sorted(p.elements(), reverse=True))] += n
                for v, k in p.items():
                    left[v] -= n * k
        made += _best_fit(left, size)
        if best is None or made.total() < best.total():
            best = made
    return [*([((size,), full)] if full else []), *sorted(best.items(), reverse=True)]


def _ranges(planned: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By length and first rank (packed): the first sequence less that rank, and the offset."""
    taken: Counter = Counter()
    keys, first, offsets = [], [], []
    sequence = 0
    for pattern, n in planned:
        at = 0
        for length in pattern:
            keys.append(length << 48 | taken[length])
            first.append(sequence - taken[length])
            offsets.append(at)
            taken[length] += n
            at += length
        sequence += n
    order = np.argsort(np.array(keys, np.int64))
    return tuple(np.array(v, np.int64)[order] for v in (keys, first, offsets))


def packed(docs: DataFrame, text: str = "text", *, keep: list[str], size: int = 2048, end: int = 0, path: str | None = None) -> DataFrame:
    """A row for each piece: the ``keep`` columns, then ``piece, start, length, ids_crc32, sequence_id, offset``.

    Each document's identifiers are followed by ``end``; null and empty texts are
    that one token.  Rows are packed one by one, repeated rows too.  The plan
    that goes to the tasks is bounded by ``size`` and the number of patterns.
    """
    if clash := {"piece", "start", "length", "ids_crc32", "sequence_id", "offset"} & set(keep):
        raise ValueError(f"columns named as results: {sorted(clash)}")
    # numbered, so that names can't clash
    kept = [f"__k{i}" for i in range(len(keep))]
    slim = docs.select(*[docs[c].alias(k) for c, k in zip(keep, kept)], docs[text].cast("string").alias("__text"))
    tail = np.array([end], "<u4").tobytes()

    def pieces(batches):
        encoder, task, seen = _encoder(path or default_path()), TaskContext.get().partitionId(), Counter()
        for b in slices(batches):
            of, out = [], [[] for _ in range(6)]
            for i, t in enumerate(b.column(len(kept)).to_pylist()):
                ids = encoder.encode(t) + tail
                for k, (start, n) in enumerate(cut(len(ids) // 4, size)):
                    of.append(i)
                    for column, value in zip(out, (k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), task, seen[n])):
                        column.append(value)
                    seen[n] += 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(of, pa.int64())) for c in b.columns[:-1]), *(pa.array(v, t) for v, t in zip(out, kinds))], names=[*kept, "piece", "start", "length", "ids_crc32", "__task", "__rank"])

    schema = slim.select(*kept).schema
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("__task", "integer"), ("__rank", "long")):
        schema = schema.add(name, kind)
    # written, so that ranks stay as they are if a task is run again
    made = written(slim.mapInArrow(pieces, schema), "pieces")
    counts = made.groupBy("length", "__task").count()
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    keys, first, offsets = _ranges(plan(histogram, size))
    before = counts.withColumn("__before", F.sum("count").over(W.partitionBy("length").orderBy("__task")) - F.col("count")).drop("count")
    # a row for a length and task is few beside the pieces, so neither side is sorted
    ranked = made.join(before.hint("shuffle_hash"), ["length", "__task"]).select(*kept, "piece", "start", "length", "ids_crc32", (F.col("__rank") + F.col("__before")).alias("__rank"))

    def place(batches):
        for b in batches:
            n, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            i = np.searchsorted(keys, n << 48 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(first[i] + rank), pa.array(offsets[i])], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, ranked.drop("__rank").schema.add("sequence_id", "long").add("offset", "long")).select(*[F.col(k).alias(c) for c, k in zip(keep, kept)], "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

"""SimHash near-duplicates through a Gray-order hierarchical index (operator 2).

A fingerprint takes the majority of every bit over the XXH64 values of a text's
word shingles.  Equal fingerprints are one node from then on, so copies cost
nothing further.  Distinct fingerprints are dealt by the pigeonhole rule: with
``m`` blocks of bits and at most ``d`` differing bits, some ``m - d`` blocks
agree, so every link meets under one such choice of blocks.  ``m`` follows the
number of fingerprints, so that groups stay small at any size; results don't
depend on it.  A group over ``group_rows`` is cut into chunks and its pairs of
chunks are dealt apart.

Inside each group the fingerprints are sorted by Gray rank.  Runs of neighbours
form leaves, runs of leaves form upper nodes, and each node keeps the bits that
all below it share, less those of its parent.  A search goes down from the root,
adds up the differences in shared bits, and leaves a whole node when they exceed
the bound.  Only a spanning forest of each group's links leaves the task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tallyfield.llm.arrowio import slices
from tallyfield.llm.graph import components
from tallyfield.llm.shared import written

BITS, SEED = 64, 42
#: Children of a node of the index.
FANOUT = 8
#: Pairs of a query and a node that a search holds at a time.
FRONTIER = 1 << 20

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """XXH64 values of the word shingles of one text, in order; of all words where they are fewer, none without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(tokens) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(start, end[words - 1 :].tolist())), np.uint64, len(start))


def fingerprint(text: str | None, words: int = 4) -> int:
    """The unsigned fingerprint of one text; 0 without words."""
    return majority(shingles(text, words))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingles: bits set in over half of them."""
    by_byte = hashes.view(np.uint8).reshape(-1, 8)  # little-endian: byte i has the bits from 8 * i
    if len(hashes) < 64:
        ones = np.unpackbits(by_byte, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(by_byte[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", *, keep: list[str], words: int = 4) -> DataFrame:
    """The ``keep`` columns and ``fingerprint`` (the 64 bits as a signed long); null texts have fingerprint zero."""
    if "fingerprint" in keep:
        raise ValueError("a column named as the result: fingerprint")
    slim = docs.select(F.struct(*[docs[c] for c in keep]).alias("__row"), docs[text].cast("string").alias("__text"))

    def run(batches):
        for b in slices(batches):
            found = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], names=["__row", "fingerprint"])

    return slim.mapInArrow(run, slim.select("__row").schema.add("fingerprint", "long")).select("__row.*", "fingerprint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray order: bit i of the rank is the parity of the bits from i up."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Hierarchical index over the fingerprints of one or more groups.

    ``group`` must be sorted; a search never leaves the query's own group.
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        self.order = np.lexsort((gray_rank(codes), group))
        self.codes, self.group = codes[self.order], group[self.order]
        #: From the leaves up: first child, number of children, mask, pattern.
        self.levels: list[tuple[np.ndarray, ...]] = []
        all_, any_, of = self.codes, self.codes, self.group
        while True:
            first_of_group = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            place = np.arange(len(of)) - np.repeat(first_of_group, np.diff(np.r_[first_of_group, len(of)]))
            first = np.flatnonzero(place % FANOUT == 0)
            all_, any_, of = np.bitwise_and.reduceat(all_, first), np.bitwise_or.reduceat(any_, first), of[first]
            mask = ~(all_ ^ any_)
            self.levels.append((first, np.diff(np.r_[first, len(place)]), mask, all_ & mask))
            if len(of) == len(first_of_group):
                break
        self.roots = of

    def search(self, codes: np.ndarray, group: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place in ``codes``, place in the indexed array) at ``most`` differing bits at most."""
        at = np.searchsorted(self.roots, group)
        inside = np.flatnonzero((at < len(self.roots)) & (self.roots[np.minimum(at, len(self.roots) - 1)] == group))
        stack = [(len(self.levels) - 1, inside, at[inside], np.zeros(len(inside), np.int64), np.zeros(len(inside), np.uint64))]
        while stack:
            level, q, node, diff, known = stack.pop()
            if len(q) > FRONTIER:
                cut = len(q) // 2
                stack += [(level, q[:cut], node[:cut], diff[:cut], known[:cut]), (level, q[cut:], node[cut:], diff[cut:], known[cut:])]
                continue
            if level < 0:
                diff = diff + np.bitwise_count((codes[q] ^ self.codes[node]) & ~known)
                near = diff <= most
                yield q[near], self.order[node[near]]
                continue
            first, n, mask, pattern = self.levels[level]
            m = mask[node]
            diff = diff + np.bitwise_count((codes[q] ^ pattern[node]) & m & ~known)
            near = diff <= most
            q, node, diff, known = q[near], node[near], diff[near], m[near]
            step = max(1, FRONTIER // FANOUT)
            for i in range(0, len(q), step):
                cut = slice(i, i + step)
                k = n[node[cut]]
                within = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                stack.append((level - 1, np.repeat(q[cut], k), np.repeat(first[node[cut]], k) + within, np.repeat(diff[cut], k), np.repeat(known[cut], k)))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest place in each place's component."""
    label = np.arange(n)
    for a, b in pairs:
        while len(a):
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                break
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def _blocks(n: int, most: int, group_rows: int) -> list[list[tuple[int, int]]]:
    """Choices of blocks, each block a (shift, width), such that groups of ``n`` random codes stay under ``group_rows`` / 4."""
    m = most + 1
    while n / 2 ** (BITS * (m - most) / m) > group_rows / 4 and m < most + 6:
        m += 1
    edges = [round(i * BITS / m) for i in range(m + 1)]
    return [list(c) for c in itertools.combinations([(a, b - a) for a, b in zip(edges, edges[1:])], m - most)]


def _key(code: Column, number: int, blocks: list[tuple[int, int]]) -> Column:
    """The bits of the blocks, packed; the number of the choice goes in on top or by hash."""
    key, used = F.lit(0).cast("long"), 0
    for shift, width in blocks:
        part = F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        key = key.bitwiseOR(F.shiftleft(part, used))
        used += width
    return F.struct(F.lit(number).alias("choice"), key.alias("bits"))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row for each component of near-duplicates: that of the smallest id, nulls first.

    Of rows with one id in a component the one with the least hash of its text
    stays.  All columns are kept as they are.
    """
    return least_of_each(docs, near_duplicates(docs, text, doc_id, keys=True, **options), text, doc_id)


def least_of_each(docs: DataFrame, found: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``docs`` with one row for each ``root`` of ``found(doc_id, t1, t2, root)``, as ``one_of_each`` says."""
    none = F.lit(-(2**63))
    chosen = found.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", none).alias("__id"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2"))).alias("c")).select("c.*")
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), F.coalesce(docs[doc_id].cast("long"), none).alias("__id"), F.xxhash64(docs[text].cast("string")).alias("__t1"), F.xxhash64(F.lit(1), docs[text].cast("string")).alias("__t2"))
    # repeated rows are equal; the join and the aggregate share one shuffle
    return keyed.join(chosen, ["__id", "__t1", "__t2"], "left_semi").groupBy("__id", "__t1", "__t2").agg(F.first("__row").alias("__row")).select("__row.*")


def links(codes: DataFrame, most: int = 4, group_rows: int = 1024) -> DataFrame:
    """``a, b``: links that join all fingerprints of ``codes(fingerprint)`` at ``most`` bits or fewer into their components."""
    codes = codes.select("fingerprint").distinct()
    choices = _blocks(codes.count(), most, group_rows)
    keyed = codes.select("fingerprint", F.explode(F.array(*[_key(F.col("fingerprint"), i, c) for i, c in enumerate(choices)])).alias("k")).select("fingerprint", "k.choice", "k.bits")
    large = keyed.groupBy("choice", "bits").count().where(F.col("count") > group_rows).select("choice", "bits", F.ceil(F.col("count") / group_rows).cast("int").alias("parts"))
    parts = keyed.join(large, ["choice", "bits"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    parts = parts.withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int"))
    dealt = parts.select("fingerprint", "choice", "bits", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("fingerprint", F.xxhash64("choice", "bits", F.least("part", "other"), F.greatest("part", "other")).alias("g"), (F.col("part") <= F.col("other")).alias("low"), (F.col("part") >= F.col("other")).alias("high"))

    def joined(code: np.ndarray, g: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
        # the index holds one chunk, the other chunk's codes are the queries
        lows, highs = np.flatnonzero(low), np.flatnonzero(high)
        index = GrayIndex(code[lows], g[lows])
        label = forest(len(code), ((highs[a], lows[b]) for a, b in index.search(code[highs], g[highs], most)))
        moved = np.flatnonzero(label != np.arange(len(code)))
        return pa.RecordBatch.from_arrays([pa.array(code[moved].view(np.int64)), pa.array(code[label[moved]].view(np.int64))], names=["a", "b"])

    def run(batches):
        held: list[np.ndarray] = []
        for b in batches:
            rows = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held = [np.concatenate(x) for x in zip(held, rows)] if held else rows
            if len(held[0]) < 20_000:
                continue
            whole = np.searchsorted(held[1], held[1][-1])  # the last group may go on in the next batch
            if whole:
                yield joined(held[0][:whole].view(np.uint64), *[x[:whole] for x in held[1:]])
                held = [x[whole:] for x in held]
        if held and len(held[0]):
            yield joined(held[0].view(np.uint64), *held[1:])

    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, words: int = 4, most: int = 4, group_rows: int = 1024, keys: bool = False) -> DataFrame:
    """``doc_id, fingerprint, component_id``, a row for each row of ``docs``.

    ``fingerprint`` has 16 lowercase hex digits.  ``component_id`` is the smallest
    ``doc_id`` that links of at most ``most`` differing bits reach, itself
    included.  Null and wordless texts have fingerprint zero and link like any
    other.  Rows that share a ``doc_id`` are nodes of their own.  A null
    ``doc_id`` counts only if a component has no other; then its id is null.
    Other columns of ``docs`` are not read.  With ``keys`` come ``t1, t2``, hashes
    of the text, and ``root``, which names a component that has no id as well.
    """
    plain = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    of_text = ["t1", "t2"] if keys else []
    plain = plain.select("*", *[k.alias(n) for k, n in zip((F.xxhash64("text"), F.xxhash64(F.lit(1), "text")), of_text)])
    marked = written(fingerprints(plain, keep=["doc_id", *of_text], words=words), "fingerprints")
    first = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    found = components(links(marked, most, group_rows))
    rooted = first.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.select("fingerprint", "root").join(least, "root").select("fingerprint", "component_id", "root")
    return marked.join(of, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", *of_text, *(["root"] if keys else []))

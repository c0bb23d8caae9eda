"""Near-duplicates by the similarity of their word shingles (the pipeline's near-dedup).

Two texts are linked if the sets of their five-word shingles have a Jaccard
similarity of 0.8 or more.  Candidates meet by SimHash: fingerprints of the same
shingles are linked at ``simhash.links``'s bits or fewer through its Gray-order
hierarchical index, and each component of fingerprints is a group.  At 0.8
fingerprints differ in about 10 bits and often in 13 or more, where no choice of
blocks that must agree tells the texts from chance; so candidates meet by MinHash
as well: ``BANDS`` keys of ``ROWS_OF_BAND`` minima each, of which two texts share
one with probability 1 - 3e-6 at a similarity of exactly 0.8, and closer to 1 above.

Each group of one key takes its texts along, and all pairs of it are verified on
the shingles.  A group over ``group_rows`` is cut into chunks and its pairs of
chunks are dealt apart.  Only a spanning forest of each group's links leaves the
task.  Equal texts are one node throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyfield.llm.arrowio import slices
from tallyfield.llm.graph import components
from tallyfield.llm.shared import written
from tallyfield.llm import simhash
from tallyfield.llm.simhash import SEED, forest, least_of_each, majority, shingles

WORDS = 5
#: Least similarity, as a fraction of whole numbers, so that it is exact.
SIMILAR = (4, 5)
BANDS, ROWS_OF_BAND = 32, 5
#: Shingles whose minima are taken at a time.
BLOCK = 4096

_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 2**64, (BANDS * ROWS_OF_BAND, 1), np.uint64) | np.uint64(1)
_PLUS = _RNG.integers(0, 2**64, (BANDS * ROWS_OF_BAND, 1), np.uint64)


def bands(hashes: np.ndarray) -> list[int]:
    """A signed key for each band of a text's shingles; one key alone for texts without words."""
    least = np.full(len(_TIMES), 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[i : i + BLOCK] * _TIMES + _PLUS).min(axis=1), out=least)
    raw = [r.tobytes() for r in least.reshape(BANDS, ROWS_OF_BAND)]
    keys = [xxhash.xxh64_intdigest(r, k) for k, r in enumerate(raw if len(hashes) else raw[:1])]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def similar_to(sets: list[np.ndarray], queries: np.ndarray, others: np.ndarray):
    """Pairs of places in ``sets`` (of ascending distinct hashes), from a query and the others, that are similar; empty sets are alike."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    of = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    ends = np.cumsum(size)
    marked = np.zeros(len(of), bool)
    counts = np.zeros(len(of) + 1, np.int64)
    for q in queries:
        own = of[ends[q] - size[q] : ends[q]]
        marked[own] = True
        np.cumsum(marked[of], out=counts[1:])
        marked[own] = False
        shared = counts[ends[others]] - counts[ends[others] - size[others]]
        near = others[SIMILAR[1] * shared >= SIMILAR[0] * (size[q] + size[others] - shared)]
        yield np.full(len(near), q), near


def by_fingerprint(marked: DataFrame) -> DataFrame:
    """``t1, key``: texts of ``marked(t1, fingerprint)`` by component of near fingerprints, which is the key."""
    nodes = marked.groupBy("t1").agg(F.first("fingerprint").alias("fingerprint"))
    root = components(simhash.links(marked)).withColumnRenamed("node", "fingerprint")
    return nodes.join(root, "fingerprint", "left").select("t1", F.xxhash64(F.lit(2), F.coalesce("root", "fingerprint")).alias("key"))


def links(marked: DataFrame, texts: DataFrame, words: int = WORDS, group_rows: int = 256) -> DataFrame:
    """``a, b``: links that join all similar texts of ``marked(t1, bands)`` into their components; ``marked`` has ``fingerprint`` too, ``texts(t1, text)`` are read for candidates."""
    nodes = marked.groupBy("t1").agg(F.first("bands").alias("bands"))
    keyed = written(nodes.select("t1", F.explode("bands").alias("key")).union(by_fingerprint(marked)), "bands")
    met = keyed.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / group_rows).cast("int").alias("parts"))
    parts = keyed.join(met, "key").withColumn("part", F.pmod(F.xxhash64(F.lit(1), "t1"), F.col("parts")).cast("int"))
    dealt = parts.select("t1", "key", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("t1", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("g"), (F.col("part") <= F.col("other")).alias("low"), (F.col("part") >= F.col("other")).alias("high"))
    dealt = written(dealt, "groups")
    read = texts.join(dealt.select("t1").distinct(), "t1", "left_semi").groupBy("t1").agg(F.first("text").alias("text"))

    def joined(node: list[int], sets: list[np.ndarray], low: list[bool], high: list[bool]) -> pa.RecordBatch:
        node = np.array(node, np.int64)
        label = forest(len(node), similar_to(sets, np.flatnonzero(high), np.flatnonzero(low)))
        moved = np.flatnonzero(label != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], names=["a", "b"])

    def run(batches):
        group, held = None, ([], [], [], [])
        for b in slices(batches):
            for g, t1, low, high, text in zip(*(c.to_pylist() for c in b.columns)):
                if g != group:
                    if len(held[0]) > 1:
                        yield joined(*held)
                    group, held = g, ([], [], [], [])
                for column, value in zip(held, (t1, np.unique(shingles(text, words)), low, high)):
                    column.append(value)
        if len(held[0]) > 1:
            yield joined(*held)

    return dealt.join(read, "t1").select("g", "t1", "low", "high", "text").repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long").distinct()


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, words: int = WORDS, group_rows: int = 256) -> DataFrame:
    """``docs`` with one row for each component of similar texts, chosen as by ``simhash.one_of_each``.

    Null and wordless texts are alike.  All columns are kept as they are.
    """
    plain = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    plain = plain.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")

    def run(batches):
        for b in slices(batches):
            hashes = [shingles(t, words) for t in b.column(3).to_pylist()]
            codes = pa.array(np.array([majority(h) for h in hashes], np.uint64).view(np.int64))
            found = pa.array([bands(h) for h in hashes], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], codes, found], names=["doc_id", "t1", "t2", "fingerprint", "bands"])

    marked = written(plain.mapInArrow(run, "doc_id long, t1 long, t2 long, fingerprint long, bands array<long>"), "minima")
    found = components(links(marked, plain.select("t1", "text"), words, group_rows))
    rooted = marked.select("doc_id", "t1", "t2").join(found.withColumnRenamed("node", "t1"), "t1", "left").withColumn("root", F.coalesce("root", "t1"))
    return least_of_each(docs, rooted, text, doc_id)

"""Line deduplication with a log-template tree (operator 8).

A line's tokens, those with a digit replaced by ``<*>``, go down a tree of fixed
depth: the number of tokens, then the leading tokens.  In a leaf, a line joins
the most similar template if enough of its tokens agree, and positions that
differ become ``<*>`` too.  A template that stands in ``least`` different texts
recurs; its lines go from all of them but the first, by document id.

Tasks first send hashes of leaves and lines.  Only leaves with several different
lines, in enough texts, have their lines read and parsed; the rest are templates
of their own.  Texts that hold none of those lines are told by a bitmap and not
read again.  A leaf of many lines is parsed in chunks first, and then the
templates of its chunks.  Whole texts are shuffled once, for the result.  Equal
texts count as one text and keep alike.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyfield.llm.arrowio import slices
from tallyfield.llm.shared import written
from tallyfield.llm.sieve import Sieve

WILD = "<*>"
#: Lines of a leaf that one task parses at most before templates are parsed again.
LEAF_LINES = 20_000

_ASCII_DIGIT = re.compile("[0-9]")
_DIGITS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isdigit())


def masked(line: str) -> list[str]:
    """Tokens between ASCII white space; those with a digit are variable."""
    if line.isascii() and line.isprintable():  # no white space but spaces
        tokens = line.split()
        return [WILD if _ASCII_DIGIT.search(t) else t for t in tokens] if _ASCII_DIGIT.search(line) else tokens
    tokens = [t.decode() for t in line.encode().split()]
    return tokens if _DIGITS.isdisjoint(line) else [t if _DIGITS.isdisjoint(t) else WILD for t in tokens]


def line_keys(line: str, depth: int) -> tuple[int, int, list[str]] | None:
    """Hashes of leaf and line (unsigned), and the tokens; None for lines without any."""
    tokens = masked(line)
    if not tokens:
        return None
    leaf = xxhash.xxh3_64_intdigest(f"{len(tokens)} {' '.join(tokens[:depth])}".encode())
    return leaf, xxhash.xxh3_64_intdigest(" ".join(tokens).encode()), tokens


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


class Leaf:
    """Templates of one leaf, found by the tokens they keep at each place."""

    def __init__(self, similar: float):
        self.similar, self.templates, self.holders = similar, [], {}

    def add(self, tokens: list[str]) -> int:
        """The number of the template that the line joins or begins; of equally similar ones, the oldest.

        A template that agrees in enough places differs in fewer than are looked
        up, so it holds one of the line's tokens that fewest templates hold.
        """
        n = len(tokens)
        wanted = next(k for k in range(n + 1) if k >= self.similar * n)
        held = sorted((self.holders.get(place, ()) for place in enumerate(tokens)), key=len)
        best, number = wanted - 1, -1
        for k in sorted(set().union(*held[: n - wanted + 1])):
            agree = sum(map(str.__eq__, self.templates[k], tokens))
            if agree > best:
                best, number = agree, k
        if number < 0:
            number = len(self.templates)
            self.templates.append(list(tokens))
            for place in enumerate(tokens):
                self.holders.setdefault(place, set()).add(number)
            return number
        template = self.templates[number]
        for i, (a, b) in enumerate(zip(template, tokens)):
            if a != b and a != WILD:
                template[i] = WILD
                self.holders[i, a].discard(number)
                self.holders.setdefault((i, WILD), set()).add(number)
        return number


def _parsed(rows: DataFrame, similar: float) -> DataFrame:
    """``leaf, part, line, template, tokens`` from ``leaf, part, line, tokens``, in the order of each ``(leaf, part)``.

    ``tokens`` of the result are those of the template at its end, in its first row only.
    """

    def parse(batches):
        key, state, held = None, None, []

        def close():
            seen: set[int] = set()
            first = [not (t in seen or seen.add(t)) for _, t in held]
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(held), pa.int64()), pa.array([key[1]] * len(held), pa.int32()), pa.array([x for x, _ in held], pa.int64()), pa.array([t for _, t in held], pa.int64()), pa.array([state.templates[t] if f else None for (_, t), f in zip(held, first)], pa.list_(pa.string()))],
                names=["leaf", "part", "line", "template", "tokens"],
            )

        for b in slices(batches, 1024):
            for leaf, part, line, tokens in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (leaf, part) != key:
                    if held:
                        yield close()
                    key, state, held = (leaf, part), Leaf(similar), []
                held.append((line, state.add(tokens)))
        if held:
            yield close()

    return rows.mapInArrow(parse, "leaf long, part int, line long, template long, tokens array<string>")


def recurring(docs: DataFrame, depth: int = 3, similar: float = 0.7, least: int = 3, leaf_lines: int = LEAF_LINES) -> DataFrame:
    """``t1, t2, lines``: hashes of the lines that go, by key of the text of ``docs(doc_id, text)``.

    Joins are by sorting throughout: what they join grows with the documents.
    """
    keyed = docs.where("text is not null").select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "doc_id", "text")

    def hashes(batches):
        for b in slices(batches):
            out: list[list] = [[], [], []]
            for i, text in enumerate(b.column(3).to_pylist()):
                for leaf, line in {k[:2] for x in text.split("\n") if (k := line_keys(x, depth))}:
                    for column, value in zip(out, (leaf, line, i)):
                        column.append(value)
            rest = b.select(["t1", "t2", "doc_id"]).take(pa.array(out[2], pa.int64()))
            yield pa.RecordBatch.from_arrays([_longs(out[0]), _longs(out[1]), *rest.columns], names=["leaf", "line", "t1", "t2", "doc_id"])

    rows = keyed.mapInArrow(hashes, "leaf long, line long, t1 long, t2 long, doc_id long")
    rows = written(rows.groupBy("leaf", "line", "t1", "t2").agg(F.coalesce(F.min("doc_id"), F.lit(-(2**63))).alias("first")), "lines")
    lines = rows.groupBy("leaf", "line").agg(F.count("*").alias("texts"), F.min(F.struct("first", "t1", "t2")).alias("holder"))
    leaves = lines.groupBy("leaf").agg(F.sum("texts").alias("in_leaf"), F.count("*").alias("n")).where(F.col("in_leaf") >= least)
    parts = F.ceil(F.col("n") / leaf_lines).cast("int").alias("parts")
    lines = written(lines.join(leaves.hint("merge"), "leaf").select("leaf", "line", "texts", "holder", (F.col("n") > 1).alias("several"), parts), "leaves")

    several = lines.where("several")
    texts, wanted = Sieve.of(several.select("holder.t1").distinct(), "t1"), Sieve.of(several, "line")

    def read(batches):
        for b in batches:
            b = b.filter(pa.array(texts.passes(b.column(0).to_numpy())))
            for b in slices([b]):
                keys = [k for text in b.column(1).to_pylist() for k in {x: line_keys(x, depth) for x in text.split("\n")}.values() if k]
                keep = np.flatnonzero(wanted.passes(np.array([k[1] for k in keys], np.uint64).view(np.int64))) if keys else []
                keys = [keys[i] for i in keep]
                yield pa.RecordBatch.from_arrays([_longs([k[0] for k in keys]), _longs([k[1] for k in keys]), pa.array([k[2] for k in keys], pa.list_(pa.string()))], names=["leaf", "line", "tokens"])

    # several texts hold a line, and the bitmaps let some lines through by chance
    different = keyed.select("t1", "text").mapInArrow(read, "leaf long, line long, tokens array<string>").groupBy("leaf", "line").agg(F.min("tokens").alias("tokens"))
    found = different.join(several.select("leaf", "line", "texts", "parts").hint("merge"), ["leaf", "line"])
    found = found.withColumn("part", F.pmod(F.xxhash64("line"), F.col("parts")).cast("int"))
    order = ["leaf", "part", F.desc("texts"), "tokens"]
    ordered = found.repartition("leaf", "part").sortWithinPartitions(*order)
    parsed = written(_parsed(ordered.select("leaf", "part", "line", "tokens"), similar), "templates")
    # what the chunks of one leaf found is parsed again; leaves of one chunk are done
    cut = several.where("parts > 1").select("leaf").distinct()
    again = parsed.where("tokens is not null").join(cut.hint("merge"), "leaf", "left_semi").select("leaf", F.xxhash64("part", "template").alias("line"), "tokens")
    again = again.repartition("leaf").sortWithinPartitions("leaf", "tokens", "line").select("leaf", F.lit(0).alias("part"), "line", "tokens")
    merged = written(_parsed(again, similar).select("leaf", F.col("line").alias("of"), F.col("template").alias("into")), "merged")
    parsed = parsed.withColumn("of", F.xxhash64("part", "template")).join(merged.hint("merge"), ["leaf", "of"], "left").select("leaf", "line", F.coalesce("into", "template").alias("template"))

    # templates of several lines: a text may hold several of them
    shared = parsed.groupBy("leaf", "template").count().where("count > 1").select("leaf", "template")
    joined = written(parsed.join(shared.hint("merge"), ["leaf", "template"]).select("leaf", "line", "template"), "shared")
    counted = rows.join(joined.hint("merge"), ["leaf", "line"]).groupBy("leaf", "template", "t1", "t2").agg(F.min("first").alias("first")).groupBy("leaf", "template").agg(F.count("*").alias("texts"), F.min(F.struct("first", "t1", "t2")).alias("holder"))
    wide = joined.join(counted.where(F.col("texts") >= least).hint("merge"), ["leaf", "template"]).select("leaf", "line", "holder")
    single = lines.where(F.col("texts") >= least).join(joined.select("leaf", "line").hint("merge"), ["leaf", "line"], "left_anti").select("leaf", "line", "holder")
    gone = written(single.union(wide).select("leaf", "line", F.col("holder.t1").alias("h1"), F.col("holder.t2").alias("h2")), "recurring")
    met = rows.select("leaf", "line", "t1", "t2").join(gone.hint("merge"), ["leaf", "line"])
    return met.where("t1 <> h1 or t2 <> h2").groupBy("t1", "t2").agg(F.collect_list("line").alias("lines"))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, keep: list[str], depth: int = 3, similar: float = 0.7, least: int = 3, leaf_lines: int = LEAF_LINES) -> DataFrame:
    """The ``keep`` columns with ``n_lines, n_dropped, kept``.

    ``kept`` is the text without its recurring lines, the rest joined as before.
    A row for each row of ``docs``; equal texts keep alike.  Null texts have no
    lines and stay null.  Lines without a token are never dropped.  A null id
    comes before all others where the first document is chosen.
    """
    if clash := {"n_lines", "n_dropped", "kept"} & set(keep):
        raise ValueError(f"columns named as results: {sorted(clash)}")
    plain = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    # written: a join of two tables can be split where one text has many copies
    gone = written(recurring(plain, depth, similar, least, leaf_lines).withColumnRenamed("lines", "__lines"), "gone")
    # one column for those that are kept, so that their names can't clash
    slim = docs.select(F.struct(*[docs[c] for c in keep]).alias("__row"), docs[text].cast("string").alias("__text"))
    marked = slim.select("*", F.xxhash64("__text").alias("t1"), F.xxhash64(F.lit(1), "__text").alias("t2")).join(gone.hint("merge"), ["t1", "t2"], "left").select("__row", "__text", "__lines")

    def run(batches):
        for b in slices(batches):
            out = [[], [], []]
            for t, drop in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                lines = t.split("\n") if t else []
                kept = lines
                if drop:
                    drop = {x % 2**64 for x in drop}
                    kept = [x for x in lines if (k := line_keys(x, depth)) is None or k[1] not in drop]
                for column, value in zip(out, (len(lines), len(lines) - len(kept), t if kept is lines else "\n".join(kept))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["__row", "n_lines", "n_dropped", "kept"])

    schema = slim.select("__row").schema.add("n_lines", "long").add("n_dropped", "long").add("kept", "string")
    return marked.mapInArrow(run, schema).select("__row.*", "n_lines", "n_dropped", "kept")

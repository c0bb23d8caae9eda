"""Toxicity scores from a weighted lexicon matched by Aho-Corasick (operator 4).

Texts are folded first: compatibility forms, look-alike letters of other
scripts, digits and signs that stand for letters, zero-width characters, case;
all else becomes spaces.  An automaton then finds lexicon entries, each a word
or the beginning of words, and exceptions, each a word or a phrase of two.  An
entry inside an exception is silent.  Where several entries start at one place
the longest counts alone.  Weights are smoothed log odds of a document being
labelled toxic.  The sum and the largest of them, taken against the length of the
text, go through a logistic function fitted on the same labelled rows.

Exceptions are learned as well: words of clean documents that begin like an entry,
and phrases of a word that holds an entry with the word before or after it, that
tell of clean documents more than of toxic ones.

Lexicon and function are learned from at most ``sample`` labelled rows; every
text is scored whole.  Languages, sources and ids are no inputs of a score.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyfield.llm.arrowio import slices
from tallyfield.llm.shared import written

#: Labelled rows to learn from, at most; those of least hash.
SAMPLE = 12_000
#: Lengths of word beginnings that can be entries.
STEMS = range(4, 11)
#: Distinct terms a task counts before it passes the counts on.
TERMS = 300_000

#: Letters of other scripts, signs and digits, with the letters they pass for.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "п": "n",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "ℓ": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
}
_ZERO_WIDTH = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
_PLAIN = {c: " " for c in range(128) if not chr(c).isalnum()} | {ord(k): v for k, v in LOOKALIKES.items()}
#: ``!`` is a letter only inside words; at their end it is punctuation, as most often.
_PLAIN[ord("!")] = " "


def fold(text: str | None) -> str:
    """The folded text, with a space at either end."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_ZERO_WIDTH)
        text = "".join(c if c.isalnum() or c < "\x80" or unicodedata.category(c)[0] == "M" else " " for c in text) if any(not (c.isalnum() or c < "\x80") for c in set(text)) else text
    return f" {text.lower().translate(_PLAIN)} "


@dataclass
class Lexicon:
    """Entries by pattern (with its leading space, and a closing one for whole words) and the logistic function."""

    weights: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, ...] = (0.0,)
    _automaton: object = None

    def __getstate__(self):
        return {"weights": self.weights, "coefficients": self.coefficients, "_automaton": None}

    def hits(self, folded: str) -> list[float]:
        """Weights of the entries that count, in the order of their starts."""
        if not self.weights:
            return []
        if self._automaton is None:
            made = ahocorasick.Automaton()
            for pattern, weight in self.weights.items():
                made.add_word(pattern, (len(pattern), weight))
            made.make_automaton()
            self._automaton = made
        longest: dict[int, tuple[int, float]] = {}
        silent: list[tuple[int, int]] = []
        for end, (size, weight) in self._automaton.iter(folded):
            start = end - size + 1
            if not weight:
                silent.append((start, end))
            elif start not in longest or longest[start][0] < end:
                longest[start] = end, weight
        if not longest:
            return []
        out, silent, at, far = [], sorted(silent), 0, -1
        for start in sorted(longest):
            while at < len(silent) and silent[at][0] <= start:
                far = max(far, silent[at][1])
                at += 1
            if longest[start][0] > far:
                out.append(longest[start][1])
        return out

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Sum of weights against the words and against their square root, the largest, and the hits, damped."""
        folded = fold(text)
        if not (hits := self.hits(folded)):
            return 0.0, 0.0, 0.0, 0.0
        words, total = max(1, len(folded.split())), sum(hits)
        return min(5.0, 10 * total / words), min(10.0, total / words**0.5), max(hits), min(3.0, float(np.log1p(len(hits))))

    def score(self, text: str | None) -> float:
        bias, *slopes = self.coefficients
        z = bias + sum(c * x for c, x in zip(slopes, self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _terms(text: str | None) -> set[str]:
    words = set(fold(text).split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEMS if len(w) > k}


def _phrases(text: str | None, entries: "Lexicon") -> set[str]:
    """Pairs of neighbouring words of which one holds an entry."""
    words = fold(text).split()
    bad = [bool(entries.hits(f" {w} ")) for w in words]
    return {f" {a} {b} " for a, b, x, y in zip(words, words[1:], bad, bad[1:]) if x or y}


def _counted(learned: DataFrame, terms) -> DataFrame:
    """``term, c, t``: in how many clean and toxic rows of ``learned(__y, __text)`` each of ``terms(text)`` stands, and for the empty term their number."""

    def count(batches):
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def rows_of():
            both = list(counts[0].keys() | counts[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *(pa.array([counts[y][t] for t in both], pa.int64()) for y in (0, 1))], names=["term", "clean", "toxic"])

        for b in slices(batches):
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts[int(y > 0)].update(terms(t))
                counts[int(y > 0)][""] += 1
            if len(counts[0]) + len(counts[1]) > TERMS:
                yield rows_of()
                counts = {0: Counter(), 1: Counter()}
        yield rows_of()

    return learned.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    b, penalty = np.zeros(x.shape[1]), ridge * np.diag([0.01, *[1.0] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, b))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by ``folds``; true for null ids, which are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Lexicon:
    """A lexicon from labelled rows outside the held-out fold.

    Rows without a label, and labels without a text, teach nothing; an id with
    several labels counts once, by its largest, and one with several texts by that
    of the least hash.  Without rows of either label all texts score alike.  What
    is gathered is bounded by ``sample``, the number of texts learned from.
    """
    rows = labels.where(F.col(label).isNotNull() & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__y"))
    rows = rows.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    # at most ``sample`` short rows are broadcast
    learned = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("__text")).where(F.col("__text").isNotNull()).join(F.broadcast(rows), "__id")
    learned = learned.groupBy("__id").agg(F.first("__y").alias("__y"), F.min(F.struct(F.xxhash64("__text").alias("h"), F.col("__text").alias("__text"))).alias("x"))
    learned = written(learned.select("__y", "x.__text").repartition(docs.sparkSession.sparkContext.defaultParallelism), "learned")
    totals = written(_counted(learned, _terms), "terms")
    n = totals.where("term = ''").first()
    if n is None or not n.c or not n.t:
        share = (n.t + 0.5) / (n.c + n.t + 1) if n else 0.5
        return Lexicon({}, (float(np.log(share / (1 - share))),))
    odds = lambda a, b: F.log((a + 0.5) / (n.t + 1)) - F.log((b + 0.5) / (n.c + 1))
    weighed = totals.where("term <> ''").withColumn("w", odds(F.col("t"), F.col("c"))).withColumn("z", F.col("w") / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5)))
    entries = weighed.where("t >= 3 and w >= 2 and z >= 2.8").orderBy(F.desc("z"), "term").collect()
    # a beginning goes where one longer entry stands for nearly all of its documents
    seen = {r.term: r.t for r in entries}
    least: dict[str, int] = {}
    for term, t in seen.items():
        for k in range(2, len(term)):
            least[term[:k]] = max(least.get(term[:k], 0), t)
    weights = {r.term: float(r.w) for r in entries if least.get(r.term, 0) < 0.9 * r.t}
    stems = sorted({t for t in weights if not t.endswith(" ")})
    if stems:
        # words of clean documents that begin like an entry
        kept = weighed.where(F.col("term").endswith(" ") & (F.col("c") >= 3) & (F.col("w") <= 0.5) & F.arrays_overlap(F.transform(F.sequence(F.lit(STEMS.start), F.lit(STEMS.stop)), lambda k: F.col("term").substr(F.lit(1), k + 1)), F.lit(stems)))
        weights |= {r.term: 0.0 for r in kept.select("term").collect()}
    if weights:
        plain = Lexicon(weights)
        around = _counted(learned, lambda t: _phrases(t, plain)).where("term <> ''").withColumn("w", odds(F.col("t"), F.col("c")))
        weights |= {r.term: 0.0 for r in around.where("c >= 3 and w <= 0").select("term").collect()}
    lexicon = Lexicon(weights)

    def measure(batches):
        for b in slices(batches):
            x = np.array([lexicon.features(t) for t in b.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.float64()), *map(pa.array, x.T)], names=["y", "a", "b", "c", "d"])

    measured = np.array([tuple(r) for r in learned.mapInArrow(measure, "y double, a double, b double, c double, d double").collect()], float)
    return Lexicon(weights, _fit(measured[:, 1:], (measured[:, 0] > 0).astype(float)))


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", *, keep: list[str]) -> DataFrame:
    """The ``keep`` columns with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 up).

    One row for each row of ``docs``; null and empty texts score as texts without
    a match.  ``keep`` columns mustn't be named as the results.
    """
    if clash := {"score", "predicted"} & set(keep):
        raise ValueError(f"columns named as results: {sorted(clash)}")
    # one column for those that are kept, so that their names can't clash
    slim = docs.select(F.struct(*[docs[c] for c in keep]).alias("__row"), docs[text].cast("string").alias("__text"))

    def run(batches):
        for b in slices(batches):
            s = [lexicon.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=["__row", "score", "predicted"])

    return slim.mapInArrow(run, slim.select("__row").schema.add("score", "double").add("predicted", "integer")).select("__row.*", "score", "predicted")

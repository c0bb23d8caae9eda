"""Quality rules with robust multivariate outliers (operator 6).

Base rules reject short and repetitive texts.  The others are judged by minimum
covariance determinant estimates of a vector of transformed statistics, made for
each language and source: a subset of three quarters of the group's rows whose
covariance has the least determinant gives centre and scatter that outliers
can't move, and rows are rejected whose Mahalanobis distance, squared, exceeds the
chi-square value that one regular text in a billion would.

Concentration steps start from a bounded sample of each group (several random
starts, the best goes on) and then run over all rows of all groups at once:
distances from the current estimates, their quantile in each group, moments of
the rows below it.  Rows never meet in one task; estimates travel by a join.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyfield.llm.arrowio import slices
from tallyfield.llm.shared import written

SYMBOLS = "#*$%&|<>"
SPACE = b"\t\n\x0b\x0c\r "
#: Transformed statistics, and the scatter that every estimate has at least, so that constant ones don't reject:
#: deviations of a quarter in the logarithms of lengths, a tenth in shares of lines and in roots of shares of words, a fiftieth in that of symbols.
FEATURES = ("f_length", "f_word", "f_symbols", "f_lines", "f_repeats")
FLOOR = (0.0625, 0.01, 0.0004, 0.01, 0.01)
#: Rows of a group that make the random starts; smaller groups than ``LEAST`` are judged with their language, then with all.
SAMPLE, STARTS, LEAST = 600, 30, 100
#: Share of a group's rows in the subset, and steps over all rows.
SUBSET, STEPS = 0.75, 4
#: Groups whose estimates, a quarter of a kilobyte each, are broadcast; more are joined by a shuffle.
BROADCAST = 10_000
#: Share of regular texts, were their statistics normal, that is rejected.
TAIL = 1e-9


def chi_square(x: float, k: int) -> float:
    """Share of a chi-square distribution with ``k`` degrees of freedom up to ``x``, by the series of the incomplete gamma function."""
    a, y = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-17:
        n += 1
        term *= y / n
        total += term
    return total * math.exp(a * math.log(y) - y - math.lgamma(a)) if y > 0 else 0.0


def chi_square_above(share: float, k: int) -> float:
    """The value that ``share`` of a chi-square distribution with ``k`` degrees of freedom exceeds; shares from 1e-12 up."""
    low, high = 0.0, 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - chi_square(mid, k) > share else (low, mid)
    return high


#: The scatter of a normal distribution's central part is smaller than that of the whole by this factor.
CONSISTENCY = SUBSET / chi_square(chi_square_above(1 - SUBSET, len(FEATURES)), len(FEATURES) + 2)
#: Mahalanobis distance, squared, that is let pass.
CUTOFF = chi_square_above(TAIL, len(FEATURES))


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(raw.count(c) for c in SPACE)
    symbols = sum(map(text.count, SYMBOLS))
    lines = Counter(x for x in raw.split(b"\n") if x.strip(SPACE))
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    repeated = 0
    if len(counts) < len(windows):
        end = 0  # past the last word counted
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return n, chars, symbols, lines.total() - len(lines), repeated


def measured(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns with the statistics and the number of lines."""
    slim = docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias("__text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "__lines"]

    def run(batches):
        for b in slices(batches):
            texts = b.column(len(keep)).to_pylist()
            out = np.array([(*statistics(t), t.count("\n") + 1 if t else 0) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, out.T)], names=[*keep, *names])

    schema = slim.select(*keep).schema
    for n in names:
        schema = schema.add(n, "long")
    return slim.mapInArrow(run, schema)


def _features() -> list[Column]:
    n = F.greatest("n_words", F.lit(1))
    return [
        F.log(n.cast("double")).alias("f_length"),
        F.log((F.col("word_chars") + 1) / n).alias("f_word"),
        F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))).alias("f_symbols"),
        (F.col("n_dup_lines") / F.greatest("__lines", F.lit(1))).cast("double").alias("f_lines"),
        F.sqrt(F.col("n_repeat_words") / n).alias("f_repeats"),
    ]


def _scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = x.mean(axis=0)
    y = x - mean
    return mean, y.T @ y / len(x) + np.diag(FLOOR)


def start(x: np.ndarray, starts: int = STARTS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter after concentration steps from random small subsets; the least determinant wins."""
    rng, h, best = np.random.default_rng(seed), max(2, int(np.ceil(SUBSET * len(x)))), None
    for _ in range(starts):
        mean, cov = _scatter(x[rng.choice(len(x), min(len(x), x.shape[1] + 1), replace=False)])
        for _ in range(10):
            y = x - mean
            d = np.einsum("ij,ij->i", y @ np.linalg.inv(cov), y)
            mean, new = _scatter(x[np.argsort(d, kind="stable")[:h]])
            if np.allclose(new, cov):
                break
            cov = new
        if best is None or np.linalg.slogdet(new)[1] < best[0]:
            best = np.linalg.slogdet(new)[1], mean, new
    return best[1], best[2]


def _distance() -> Column:
    """Squared, from ``mean`` and the inverse scatter ``inv`` (by rows) of the row."""
    y = [F.col(f) - F.col("mean")[i] for i, f in enumerate(FEATURES)]
    k = len(y)
    return sum((y[i] * y[j] * F.col("inv")[i * k + j] for i in range(k) for j in range(k)), F.lit(0.0))


def _joined(rows: DataFrame, groups: DataFrame, on, how: str = "inner") -> DataFrame:
    """``rows`` with what ``groups`` has for them; up to ``BROADCAST`` groups, counted, go to all tasks."""
    return rows.join(F.broadcast(groups) if groups.count() <= BROADCAST else groups, on, how)


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """``g, mean, inv`` of each group of ``rows(g, *FEATURES)``."""
    k = len(FEATURES)
    order = F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64(*FEATURES, "u")))
    # a group's rows are thinned by hash to a few times the sample before any of them meet
    sizes = written(rows.groupBy("g").agg(F.count("*").alias("size")), "sizes")
    mark = F.pmod(F.xxhash64(*FEATURES, "u"), F.lit(1_000_000)) / 1_000_000.0
    few = _joined(rows, sizes, "g").where(mark * F.col("size") < 2 * SAMPLE).select("g", *FEATURES, "u").withColumn("i", order).where(F.col("i") <= SAMPLE)

    def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("i")[list(FEATURES)].to_numpy()
        mean, cov = start(x)
        return pd.DataFrame({"g": [key[0]], "mean": [mean.tolist()], "inv": [np.linalg.inv(cov).ravel().tolist()]})

    now = written(few.groupBy("g").applyInPandas(first, "g string, mean array<double>, inv array<double>"), "estimates")

    @F.pandas_udf("array<double>")
    def inverse(cov: pd.Series) -> pd.Series:
        return cov.map(lambda c: np.linalg.inv(np.array(c).reshape(k, k) + np.diag(FLOOR)).ravel().tolist())

    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    for _ in range(steps):
        far = _joined(rows, now, "g").select("g", *FEATURES, _distance().alias("d"))
        bound = written(far.groupBy("g").agg(F.percentile_approx("d", SUBSET, 2000).alias("bound")), "bounds")
        near = _joined(far, bound, "g").where("d <= bound")
        sums = near.groupBy("g").agg(F.count("*").alias("n"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)], *[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}_{j}") for i, j in pairs])
        cov = F.array(*[F.col(f"c{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)])
        now = written(sums.select("g", F.array(*[f"m{i}" for i in range(k)]).alias("mean"), inverse(cov).alias("inv")), "estimates")
    return now


def judged(docs: DataFrame, text: str = "text", *, keep: list[str], lang: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """The ``keep`` columns with the statistics, ``base_failed, kept`` and ``distance``.

    A row for each row of ``docs``.  Null texts have no words and fail the base
    rules.  Null languages and sources make groups of their own.  Groups with
    fewer than ``LEAST`` rows that pass the base rules are judged with all of
    their language, languages likewise with all rows; with too few rows at all,
    passing the base rules is enough.
    """
    results = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"}
    if clash := results & set(keep):
        raise ValueError(f"columns named as results: {sorted(clash)}")
    # one column for those that are kept, so that their names can't clash
    named = docs.select(F.struct(*[docs[c] for c in keep]).alias("__row"), docs[text].alias("__text"), F.coalesce(docs[lang].cast("string"), F.lit("\0")).alias("__lang"), F.coalesce(docs[source].cast("string"), F.lit("\0")).alias("__source"))
    stats = measured(named, "__text", ["__row", "__lang", "__source"])
    stats = stats.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    stats = written(stats.select("*", *_features()), "statistics")
    passed = stats.where("not base_failed").withColumn("u", F.xxhash64("__row"))
    finest = F.concat_ws("\1", F.lit("s"), "__lang", "__source")
    middle = F.concat_ws("\1", F.lit("l"), "__lang")
    at = written(passed.groupBy("__lang", "__source").count().select("__lang", "__source", "count", finest.alias("fine"), middle.alias("mid")), "groups")
    by_lang = at.groupBy("mid").agg(F.sum("count").alias("of_lang"))
    level = at.join(by_lang, "mid").select("__lang", "__source", F.when(F.col("count") >= LEAST, F.col("fine")).when(F.col("of_lang") >= LEAST, F.col("mid")).otherwise(F.lit("all")).alias("own"))
    # every row counts for its own group, and for wider ones that some group needs
    wider = level.where(~F.col("own").startswith("s")).select("own").distinct()
    rows = passed.select(F.explode(F.array(finest, middle, F.lit("all"))).alias("g"), "u", *FEATURES)
    wanted = level.select(F.col("own").alias("g")).union(wider.select(F.col("own").alias("g"))).distinct()
    rows = written(_joined(rows, written(wanted, "wanted"), "g"), "judged")
    found = estimates(rows).where(F.size("mean") > 0)
    of_groups = written(level.join(found.withColumnRenamed("g", "own"), "own"), "estimates")
    all_rows = _joined(stats, of_groups, ["__lang", "__source"], "left")
    distance = F.when(F.col("mean").isNotNull(), _distance())
    out = all_rows.withColumn("distance", F.when(~F.col("base_failed"), distance / CONSISTENCY))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("__row.*", *names, "base_failed", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"), "distance")

"""Correlation functions from pair counts, by the Landy-Szalay estimator.

Counts are tables as the pair counters return them; they are matched on their
bins.  Weights play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_LS = ("LS", "ls", "Landy", "landy", "Landy-Szalay")


def _matched(tables: dict[str, DataFrame], keys: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """The tables' counts by bin, and columns ``more`` of the first.

    Each table is fetched once, as many rows as it has bins, so that pairs aren't
    counted again by what follows.
    """
    spark = next(iter(tables.values())).sparkSession
    fetched: dict[int, list] = {}
    out = None
    for name, t in tables.items():
        if id(t) not in fetched:
            fetched[id(t)] = t.select(*keys, "npairs", *[c for c in more if c in t.columns]).collect()
        rows = [(*r[: len(keys)], float(r["npairs"]), *([] if out else [float(r[c]) for c in more])) for r in fetched[id(t)]]
        schema = ", ".join([*(f"`{k}` double" for k in keys), f"{name} double", *([] if out else [f"`{c}` double" for c in more])])
        table = spark.createDataFrame(rows, schema)
        out = table if out is None else out.join(table, keys)
    if len(sizes := {len(v) for v in fetched.values()}) > 1:
        raise ValueError(f"tables differ in their number of bins: {sorted(sizes)}")
    return out


def _estimate(nd1: int, nd2: int, nr1: int, nr2: int):
    f1, f2 = nr1 / nd1, nr2 / nd2
    over = f1 * f2 * F.col("d1d2") - f1 * F.col("d1r2") - f2 * F.col("d2r1") + F.col("r1r2")
    return F.when(F.col("r1r2") > 0, F.try_divide(over, F.col("r1r2"))).otherwise(float("nan"))


def convert_3d_counts_to_cf(nd1: int, nd2: int, nr1: int, nr2: int, d1d2: DataFrame, d1r2: DataFrame, d2r1: DataFrame, r1r2: DataFrame, estimator: str = "LS", keys: list[str] | None = None) -> DataFrame:
    """The bin columns and ``cf``; NaN where there are no random pairs."""
    if estimator not in _LS:
        raise ValueError(f"estimator {estimator!r} isn't known; Landy-Szalay is 'LS'")
    keys = keys or [c for c in d1d2.columns if c not in ("npairs", "weightavg", "cf") and not c.endswith("avg")]
    found = _matched({"d1d2": d1d2, "d1r2": d1r2, "d2r1": d2r1, "r1r2": r1r2}, keys)
    return found.select(*keys, _estimate(nd1, nd2, nr1, nr2).alias("cf")).orderBy(*keys)


def convert_rp_pi_counts_to_wp(nd1: int, nd2: int, nr1: int, nr2: int, d1d2: DataFrame, d1r2: DataFrame, d2r1: DataFrame, r1r2: DataFrame, nrpbins: int, pimax: float, dpi: float = 1.0, estimator: str = "LS") -> DataFrame:
    """``rmin, rmax, wp``: twice the sum over the line of sight; NaN where any bin is."""
    n = int(pimax / dpi)
    if dpi * n != pimax:
        raise ValueError("pimax must be a whole number of dpi")
    cf = convert_3d_counts_to_cf(nd1, nd2, nr1, nr2, d1d2, d1r2, d2r1, r1r2, estimator, ["rmin", "rmax", "pimax"])
    out = cf.groupBy("rmin", "rmax").agg((2.0 * dpi * F.sum("cf")).alias("wp"), F.count("*").alias("n"))
    bad = out.where(F.col("n") != n).count()
    if bad or out.count() != nrpbins:
        raise ValueError("the tables haven't nrpbins times pimax / dpi bins")
    return out.select("rmin", "rmax", "wp").orderBy("rmin")


def wprp(nd1: int, nd2: int, nr1: int, nr2: int, d1d2: DataFrame, d1r2: DataFrame, d2r1: DataFrame, r1r2: DataFrame, pimax: float, all_bins: bool = False) -> DataFrame:
    """``rmin, rmax, rpavg, wp`` with the mean separation weighted by pairs.

    Sums the bins up to ``int(pimax)``, or with ``all_bins`` all of them, as for
    mock catalogues.  Bins without random pairs give NaN.
    """
    keys = ["rmin", "rmax", "pimax"]
    found = _matched({"d1d2": d1d2, "d1r2": d1r2, "d2r1": d2r1, "r1r2": r1r2}, keys, ("rpavg",))
    if not all_bins:
        found = found.where(F.col("pimax") <= int(pimax))
    step = found.agg(F.min("pimax")).first()[0] or 1.0
    mean = F.coalesce(F.try_divide(F.sum(F.col("rpavg") * F.col("d1d2")), F.sum("d1d2")), F.lit(0.0))
    return found.withColumn("cf", _estimate(nd1, nd2, nr1, nr2)).groupBy("rmin", "rmax").agg(mean.alias("rpavg"), (2.0 * step * F.sum("cf")).alias("wp")).orderBy("rmin")


def wtheta(nd1: int, nd2: int, nr1: int, nr2: int, d1d2: DataFrame, d1r2: DataFrame, d2r1: DataFrame, r1r2: DataFrame) -> DataFrame:
    """``thetamin, thetamax, wtheta``."""
    return convert_3d_counts_to_cf(nd1, nd2, nr1, nr2, d1d2, d1r2, d2r1, r1r2, keys=["thetamin", "thetamax"]).withColumnRenamed("cf", "wtheta")

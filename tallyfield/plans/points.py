"""Point sets: columns ``id, x, y, z, w`` in double precision."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyfield.functions.weights import all_weights, first_weight


def weights_of(df: DataFrame, weights: str | None) -> list[Column]:
    """``w``, the weight that products use, and for an array column ``ws``, all of them."""
    if weights is None:
        return [F.lit(1.0).alias("w")]
    is_array = isinstance(df.schema[weights].dataType, T.ArrayType)
    return [first_weight(F.col(weights), is_array).alias("w"), *([all_weights(F.col(weights)).alias("ws")] if is_array else [])]


def xyz(df: DataFrame, x: str = "x", y: str = "y", z: str = "z", weights: str | None = None, id: str | None = None) -> DataFrame:
    """``id, x, y, z, w[, ws]``.

    Without an ``id`` column rows are numbered.  Ids only spread the points of
    crowded places over tasks, so numbers needn't be alike when read again.
    """
    number = F.col(id).cast("long") if id else F.monotonically_increasing_id()
    return df.select(number.alias("id"), *[F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))], *weights_of(df, weights))


@dataclass(frozen=True)
class Extent:
    """Number of points, their bounds, and sums of weights."""

    n: int
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    sum_w: float
    sum_w2: float

    @staticmethod
    def of(points: DataFrame) -> Extent:
        """One pass over the points; NaN coordinates are refused."""
        row = points.selectExpr("count(*)", *[f"{f}({c})" for f in ("min", "max") for c in "xyz"], "sum(w)", "sum(w * w)").first()
        n, *v = row
        if n == 0:
            return Extent(0, (0.0,) * 3, (0.0,) * 3, 0.0, 0.0)
        if any(c is None or c != c or abs(c) == float("inf") for c in v[:6]):
            raise ValueError("coordinates must be finite")
        return Extent(n, tuple(v[:3]), tuple(v[3:6]), v[6], v[7])

    def __or__(self, other: Extent) -> Extent:
        if not self.n or not other.n:
            return self if self.n else other
        return Extent(self.n + other.n, tuple(map(min, self.low, other.low)), tuple(map(max, self.high, other.high)), self.sum_w + other.sum_w, self.sum_w2 + other.sum_w2)

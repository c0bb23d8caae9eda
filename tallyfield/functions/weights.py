"""Weights of points and of pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, functions as F

#: Weights of pairs from both points' weights and the separations along the axes, all NumPy arrays over pairs.
#: Where points have several weights (``ws``), functions of the user get arrays of shape (weights, pairs).
WeightFn = Callable[..., np.ndarray]

#: At most so many weights of a point.
MAX_WEIGHTS = 10


def pair_product(wa: np.ndarray, wb: np.ndarray, *_: np.ndarray) -> np.ndarray:
    return wa * wb


WEIGHT_TYPES: dict[str, WeightFn] = {"pair_product": pair_product, "p": pair_product}


def weight_function(kind: str | WeightFn | None) -> WeightFn | None:
    """By name or as given; None and the empty name are no weights."""
    if not kind or callable(kind):
        return kind or None
    if kind not in WEIGHT_TYPES:
        raise ValueError(f"weight type {kind!r} is none of {sorted(WEIGHT_TYPES)}")
    return WEIGHT_TYPES[kind]


def first_weight(weights: Column, is_array: bool) -> Column:
    """The weight that products use; nulls weigh 1."""
    return F.coalesce((F.get(weights, F.lit(0)) if is_array else weights).cast("double"), F.lit(1.0))


def all_weights(weights: Column) -> Column:
    """Each of a point's weights, nulls as 1; more than ``MAX_WEIGHTS`` are refused."""
    each = F.transform(F.coalesce(weights, F.array(F.lit(1.0))), lambda w: F.coalesce(w.cast("double"), F.lit(1.0)))
    return F.when(F.size(each) <= MAX_WEIGHTS, each).otherwise(F.raise_error(F.lit(f"a point has at most {MAX_WEIGHTS} weights")).cast("array<double>"))

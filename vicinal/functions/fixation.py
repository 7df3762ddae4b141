"""Rate multipliers by selection difference, as column expressions. Only named functions: configuration text is never evaluated."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F


def shape(ds: Column, ne: float) -> Column:
    a = F.abs(ds)
    return F.when(ds == 0, 1.0).otherwise(ne * F.expm1(2 * a) / F.expm1(2 * ne * a))


def popgen(ds: Column, ne: float) -> Column:
    return F.when(ds == 0, 1.0).otherwise(ne * F.expm1(-2 * ds) / F.expm1(-2 * ne * ds))


def ising(ds: Column) -> Column:
    return 1 / (1 + F.exp(-ds))


def null(ds: Column) -> Column:
    return F.lit(1.0)


#: The same on arrays, for the generators of small models.
ON_ARRAYS = {
    "shape": lambda ds, ne: _ratio(np.abs(ds), 2.0, ne),
    "popgen": lambda ds, ne: _ratio(ds, -2.0, ne),
    "ising": lambda ds: 1 / (1 + np.exp(-ds)),
    "null": lambda ds: np.ones_like(ds),
}


def _ratio(ds: np.ndarray, k: float, ne: float) -> np.ndarray:
    """ne expm1(k ds) / expm1(k ne ds), 1 where ds is 0."""
    some = np.where(ds == 0, 1.0, ds)
    return np.where(ds == 0, 1.0, ne * np.expm1(k * some) / np.expm1(k * ne * some))


#: Name: function and its parameters.
REGISTRY = {"shape": (shape, ("Ne",)), "popgen": (popgen, ("Ne",)), "ising": (ising, ()), "null": (null, ())}


def parse(name: str, params: dict[str, float] | None = None, arrays: bool = False):
    """The function of that name with its parameters set, on columns or on arrays; unknown names and wrong parameters are errors."""
    name = name.removesuffix(".fixfn")
    if name not in REGISTRY:
        raise ValueError(f"no fixation function named {name}")
    fn, wants = REGISTRY[name]
    if set(params or {}) != set(wants):
        raise ValueError(f"{name} takes the parameters {wants}")
    fn = ON_ARRAYS[name] if arrays else fn
    return lambda ds: fn(ds, *[params[k] for k in wants])

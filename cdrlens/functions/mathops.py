"""One notation for formulas that run both as Spark columns and on NumPy arrays.

``COL`` builds Catalyst expressions (whole-stage code), ``NP`` computes arrays inside a kernel; each
formula in this package is written once and takes either.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import functions as F


class _Numpy:
    sqrt, exp, log10, sin, cos, tan = np.sqrt, np.exp, np.log10, np.sin, np.cos, np.tan
    arctan2, hypot, floor, absolute = np.arctan2, np.hypot, np.floor, np.abs
    arcsin = np.arcsin

    @staticmethod
    def least(*xs):
        return functools.reduce(np.minimum, xs)

    @staticmethod
    def greatest(*xs):
        return functools.reduce(np.maximum, xs)

    @staticmethod
    def where(cond, a, b):
        return np.where(cond, a, b)

    @staticmethod
    def power(x, y):
        return np.power(x, y)

    @staticmethod
    def remainder(x, y):
        """Remainder with the sign of x."""
        return np.fmod(x, y)

    @staticmethod
    def round_away(x):
        """Nearest whole number, halves away from zero."""
        return np.trunc(x + np.copysign(0.5, x))


class _Columns:
    sqrt, exp, log10, sin, cos, tan = F.sqrt, F.exp, F.log10, F.sin, F.cos, F.tan
    arctan2, hypot, absolute = F.atan2, F.hypot, F.abs
    arcsin = F.asin

    @staticmethod
    def _column(x):
        return F.lit(float(x)) if isinstance(x, (int, float)) else x

    @classmethod
    def floor(cls, x):
        return F.floor(x).cast("double")

    @classmethod
    def least(cls, *xs):
        return F.least(*map(cls._column, xs))

    @classmethod
    def greatest(cls, *xs):
        return F.greatest(*map(cls._column, xs))

    @classmethod
    def where(cls, cond, a, b):
        return F.when(cond, cls._column(a)).otherwise(cls._column(b))

    @classmethod
    def power(cls, x, y):
        return F.pow(cls._column(x), cls._column(y))

    @classmethod
    def remainder(cls, x, y):
        return x % y

    @classmethod
    def round_away(cls, x):
        return F.round(x)


NP, COL = _Numpy, _Columns

_erfc = np.frompyfunc(math.erfc, 1, 1)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """Standard normal distribution function."""
    return 0.5 * _erfc(-np.asarray(x, float) / math.sqrt(2)).astype(float)

"""Rounding the way NumPy / pandas round floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def np_round(c: Column, places: int) -> Column:
    """``numpy.round(x, n)``: scale, round half to even on the scaled double, unscale.
    (Spark's ``bround`` rounds the exact decimal value instead, like Python's ``round``.)"""
    scale = float(10 ** places)
    return F.rint(c * scale) / scale

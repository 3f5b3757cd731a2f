"""Rounding that matches Python/pandas and SQL engines on binary doubles.

Spark's ``round`` rounds the decimal string of a double (0.575 -> 0.58),
while Python and DuckDB round the binary value (0.57499... -> 0.57).  ``rnd``
scales, rounds half away from zero on the binary product, and scales back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(c, digits: int = 0) -> Column:
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    p = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * p + 0.5) / p

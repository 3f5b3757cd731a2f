"""Date helpers (C07-C09). Session time zone is expected to be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text forms tried in order after the ISO default; unparseable text is NULL.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "yyyy-MM-dd'T'HH:mm:ss"]


def parse_date(c) -> Column:
    """Text or timestamp -> timestamp; garbage -> NULL (never an error)."""
    c = F.col(c) if isinstance(c, str) else c
    s = c.cast("string")
    tries = [F.try_to_timestamp(s)] + [F.try_to_timestamp(s, F.lit(f)) for f in DATE_FORMATS]
    return F.coalesce(*tries).cast("timestamp_ntz")


def quarter_label(d: Column) -> Column:
    """``2024Q1``."""
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def month_label(d: Column) -> Column:
    """``2024-01``."""
    return F.date_format(d, "yyyy-MM")


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days (floor of the difference, like pandas ``.dt.days``)."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("bigint")

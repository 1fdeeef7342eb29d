"""Decimal rounding of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(value: Column | str, digits: int) -> Column:
    """Scale, round half to even, scale back: the rounding of array libraries, which users of
    the feature tables know. Plain IEEE steps, so any engine that repeats them agrees bit for
    bit, and cheaper in generated code than the decimal arithmetic of ``round``."""
    column = F.col(value) if isinstance(value, str) else value
    scale = float(10**digits)
    return F.rint(column * scale) / scale

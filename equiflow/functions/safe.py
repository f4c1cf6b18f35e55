"""ANSI-safe column arithmetic.

Spark 4 runs in ANSI mode: ``/ 0``, bad casts and out-of-range indexing raise.
The reference (pandas) yields NaN/inf there, so every division, cast and
element access in the engine goes through these helpers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / b, NULL when b is 0 or NULL."""
    return F.try_divide(col(a), col(b))

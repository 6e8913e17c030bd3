"""What the column functions share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that stands in the plan once, held by a lambda's variable, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))

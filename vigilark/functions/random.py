"""Pseudo-random numbers that any SQL engine can repeat: digits of an md5 digest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) that depends on the parts, joined by '|'."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)

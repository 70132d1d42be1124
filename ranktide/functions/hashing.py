"""Random numbers from a hash of what they are for: the same on any partitioning and any retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 4503599627370496.0


def uniform(*parts: Column | str | int) -> Column:
    """A number in (0, 1) from the parts, joined by colons."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") + 0.5) / SCALE


def normal(*parts: Column | str | int) -> Column:
    """A standard normal number, by Box and Muller from two uniform ones."""
    return F.sqrt(-2.0 * F.log(uniform("r", *parts))) * F.cos(6.283185307179586 * uniform("a", *parts))

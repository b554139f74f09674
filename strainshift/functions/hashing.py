"""Reproducible random numbers from keys: same value on any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mammen's two-point law.
MAMMEN_LOW = (1 - math.sqrt(5)) / 2
MAMMEN_HIGH = (1 + math.sqrt(5)) / 2
MAMMEN_P_LOW = (math.sqrt(5) + 1) / (2 * math.sqrt(5))


def hash_uniform(*parts) -> Column:
    """Uniform on [0,1) from the text of the parts, 52 bits of an md5 digest."""
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", *texts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / 4503599627370496


def wild_weight(law: str, *parts) -> Column:
    """A weight with mean 0 and variance 1 for the key given by the parts."""
    name = law.lower()
    u = hash_uniform(*parts)
    if name == "rademacher":
        return F.when(u < 0.5, 1.0).otherwise(-1.0)
    if name == "mammen2":
        return F.when(u < MAMMEN_P_LOW, MAMMEN_LOW).otherwise(MAMMEN_HIGH)
    if name == "standard normal":
        v = hash_uniform(*parts, "angle")
        return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * math.pi * v)
    raise ValueError("law must be 'standard normal', 'Rademacher' or 'Mammen2'")

"""Interpretation bands for the Personal Information Factor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bound of each data-safe level, level 5 lies below the last.
SAFE_LEVEL_BOUNDS = {1: 1.00, 2: 0.33, 3: 0.11, 4: 0.04}


def safe_level(pif: Column) -> Column:
    """Data-safe level 1 (most identifying) to 5; NULL for a NULL factor."""
    level = F.when(pif.isNull(), F.lit(None).cast("int"))
    for number, bound in SAFE_LEVEL_BOUNDS.items():
        level = level.when(pif >= bound, F.lit(number))
    return level.otherwise(F.lit(5))

"""Keeping rows without a key from piling up in one task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SALTS = 1024


def null_salt(missing: Column, *spread: str) -> Column:
    """Second join key: 0 where the key is there; where it is missing, a number that spreads the rows.

    Rows with a NULL key match nothing in a left join but would all be sent to the same task.
    """
    return F.when(missing, F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("bigint")

"""Work on keyed rows when one key may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT = "_salt"


def join_per_group(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    salts: int = 32,
) -> DataFrame:
    """Join ``lookup`` (one row per ``keys``) to ``rows``; ``how`` is inner, left or left_semi.

    Rows get a salt from their ``spread`` columns and each lookup row is repeated per salt, so a
    group is shared by ``salts`` tasks. The result is that of the plain join.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    repeated = lookup.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn(SALT, salt).join(repeated, [*keys, SALT], how).drop(SALT)

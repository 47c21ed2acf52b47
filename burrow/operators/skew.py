"""Equi-joins in which one key may hold a large share of one side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burrow.session import materialise

TARGET_ROWS = 2_000_000
MAX_HOT_KEYS = 20_000


def key_counts(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """Stored rows per key as ``_n``, and their sum."""
    counts = materialise(df.groupBy(*keys).agg(F.count("*").alias("_n")), "counts")
    return counts, counts.agg(F.sum("_n")).first()[0] or 0


def hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    target: int = TARGET_ROWS,
    limit: int = MAX_HOT_KEYS,
    counted: tuple[DataFrame, int] | None = None,
) -> tuple[DataFrame | None, int]:
    """Keys with more than ``target`` rows and the number of salts each needs.

    The target is at least one part in ``limit`` of all rows, so that no more
    than ``limit`` keys can have more; the list is small enough to broadcast,
    and a key under the target is a small share of the whole. ``counted`` are
    the key counts, if they are known.
    """
    counts, rows = counted or key_counts(df, keys)
    target = max(target, -(-rows // limit))
    hot = counts.where(F.col("_n") > target).select(
        *keys, F.ceil(F.col("_n") / F.lit(target)).cast("int").alias("_salts")
    )
    return (None, target) if hot.isEmpty() else (hot, target)


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    salt_on: Sequence[str],
    how: str = "inner",
    target: int = TARGET_ROWS,
    hashed: bool = False,
) -> DataFrame:
    """Join in which hot keys of ``big`` are spread over several salts.

    ``salt_on`` are columns of ``big`` that vary inside a hot key. Rows of
    ``small`` are repeated once per salt of their key, and only for hot keys.
    ``hashed`` keeps a task's share of ``small`` in memory, which must be known
    to be little, and leaves ``big`` unsorted.
    """
    keys = list(keys)
    hot, _ = hot_keys(big, keys, target)
    if hot is None:
        return big.join(small.hint("shuffle_hash") if hashed else small, keys, how)
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = (
        big.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*salt_on), salts).cast("int"))
        .drop("_salts")
    )
    right = (
        small.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    right = right.hint("shuffle_hash") if hashed else right
    return left.join(right, [*keys, "_salt"], how).drop("_salt")

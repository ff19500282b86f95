"""Keeping one hot key from landing in one task."""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

DEFAULT_SALTS = 16


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread: Sequence[Column | str],
    *,
    how: str = "inner",
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """Equi-join in which each key of `big` is spread over `salts` tasks.

    Every row of `small` is repeated once per salt, so use it when `small` is
    much smaller than `big`. `spread` are columns of `big` that differ among
    the rows of one key; they are hashed, so a retried task makes the same
    choice again. Only inner, left-semi and big-side left joins are correct
    with repeated rows on the right.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"salted_join cannot do a {how} join")
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    repeated = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*keys, "__salt"], how).drop("__salt")


ROWS_PER_TASK = 1_000_000
MAX_HOT_KEYS = 10_000  # what may be broadcast; more are marked by a join


def weighted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread: Sequence[Column | str],
    weight: str,
    *,
    reduce: Callable[[DataFrame], DataFrame] = lambda df: df,
    rows_per_task: int = ROWS_PER_TASK,
    max_hot: int = MAX_HOT_KEYS,
) -> DataFrame:
    """Inner equi-join that salts only the keys that need it.

    `weight` is a column of `small` that bounds the rows of its key in `big`;
    `small` must be materialized, as its weights are looked at first. Without a
    heavy key this is a plain join. Heavy keys are marked in `big`, by a broadcast
    if its checked length allows, and each is dealt to as many salts as its
    weight asks for; all other keys stay as they are. `reduce` is applied to
    `big` first when there are heavy keys.
    """
    heavy = F.col(weight) > rows_per_task
    n_heavy = small.agg(F.count_if(heavy)).first()[0]
    if not n_heavy:
        return big.join(small, list(keys))
    salts = F.ceil(F.col(weight) / rows_per_task).cast("int")
    hot = small.where(heavy).select(*keys, salts.alias("__salts"))
    if n_heavy <= max_hot:
        hot = F.broadcast(hot)
    salt = F.pmod(F.xxhash64(*spread), F.coalesce("__salts", F.lit(1))).cast("int")
    marked = reduce(big).join(hot, list(keys), "left").withColumn("__salt", salt).drop("__salts")
    copies = F.when(heavy, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))
    return marked.join(
        small.withColumn("__salt", F.explode(copies)), [*keys, "__salt"]
    ).drop("__salt")

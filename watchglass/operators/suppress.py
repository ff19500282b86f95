"""At most one alert per key within a time span, counted from the last kept one.

Decisions are made on whole seconds: rows of one key and second are reduced to
one before anything else. Keys are then dealt to tasks, their seconds sorted,
and one pass jumps from each kept second to the first one that is late enough.
The pass holds an Arrow batch and the last kept second. A key costs at most one
row per second of its time range, however many alerts it has. Correlation
alerts fire on window ends, which are whole seconds. Rows without a time are
not limited.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.durable import materialize


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted seconds those to keep; __new marks where a key begins."""
    due = None  # the second from which the current key may be kept again
    for batch in batches:
        n = batch.num_rows
        second = batch.column("__second").to_numpy()
        span = batch.column("__span").to_numpy(zero_copy_only=False)
        new = batch.column("__new").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        edges = np.unique(np.concatenate(([0], starts, [n])))
        keep = np.zeros(n, bool)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            at = a if new[a] or due is None else a + int(np.searchsorted(second[a:b], due))
            if new[a]:
                due = None
            while at < b:
                keep[at] = True
                due = int(second[at]) + max(1, int(span[at]))
                at = a + int(np.searchsorted(second[a:b], due))
        yield batch.filter(pa.array(keep)).select(batch.schema.names[:-2])


def _kept_seconds(seconds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, __second) to keep, from distinct (keys, __second, __span)."""
    order = Window.partitionBy(*keys).orderBy("__second")
    marked = seconds.select(
        *keys, "__second", F.coalesce("__span", F.lit(0)).cast("bigint").alias("__span"),
        (F.row_number().over(order) == 1).alias("__new"),
    )
    return marked.mapInArrow(_kept, seconds.select(*keys, "__second").schema)


def keep_spaced(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    span: Column | int,
    *,
    order: Sequence[str] = (),
) -> DataFrame:
    """The rows of each key that a rate limit of one per `span` seconds lets through.

    `order` breaks ties between rows of one second. `span` may be a column that
    is constant per key.
    """
    span = F.lit(span) if isinstance(span, int) else span
    names = df.columns
    first = F.struct(F.col(time).alias("__time"), *[F.col(c) for c in order], F.struct(*names).alias("__row"))
    timed, untimed = df.where(F.col(time).isNotNull()), df.where(F.col(time).isNull())
    per_second = materialize(
        timed.withColumn("__second", F.unix_seconds(F.col(time)))
        .groupBy(*keys, "__second")
        .agg(F.min(first).alias("__first"), F.max(span).cast("bigint").alias("__span"))
    )
    kept = _kept_seconds(per_second.select(*keys, "__second", "__span"), keys)
    # A missing key is a key like any other, hence the null-safe equality.
    same = [F.col(f"all.{k}").eqNullSafe(F.col(f"kept.{k}")) for k in (*keys, "__second")]
    return (
        per_second.alias("all").join(kept.alias("kept"), same, "left_semi")
        .select("__first.__row.*").select(*names).unionByName(untimed)
    )


def suppress_alerts(alerts: DataFrame, seconds: int | None = None) -> DataFrame:
    """One alert per (rule, key) within each rule's own span, or `seconds` for all."""
    span = F.col("suppress_seconds") if seconds is None else seconds
    return keep_spaced(
        alerts, ["rule_id", "correlation_key"], "fired_at", span, order=["window_end"]
    )

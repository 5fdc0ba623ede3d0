"""Order-dependent running values that survive a hot key.

A window puts all rows of a key into one task.  That is right while keys are small,
and wrong once one job, run or path holds a large share of the rows.  ``ordered_scan``
takes the window when every key is known to be small, and otherwise splits the rows
into range-sorted blocks, runs the window inside each block and adds what earlier
blocks of the same key carried over.  Both ways give the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetflow.session import freeze

GROUP_LIMIT_CONF = "assetflow.group.rows"
GROUP_LIMIT = 2_000_000


def group_limit(df: DataFrame) -> int:
    """Rows of one key a single task may hold."""
    return int(df.sparkSession.conf.get(GROUP_LIMIT_CONF, str(GROUP_LIMIT)))


def any_group_over(df: DataFrame, keys: list[str], limit: int | None = None) -> bool:
    """Whether one key holds more than ``limit`` rows.  The rows of every key are counted: only the keys are
    read, and each map task pre-aggregates them.  No estimate of a size takes part in the answer."""
    limit = group_limit(df) if limit is None else limit
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else df.agg(F.count(F.lit(1)).alias("n"))
    return not counts.filter(F.col("n") > limit).isEmpty()


def _columns(order: list[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    sums: dict[str, Column] | None = None,
    carries: dict[str, Column] | None = None,
    spread: bool | None = None,
) -> DataFrame:
    """Per key, in ``order``: ``sums`` are running totals up to and including the row;
    ``carries`` hold the last non-null value of an expression *before* the row.
    ``order`` must not leave ties between rows that differ.  ``spread`` says whether keys
    are to be split into blocks; by default the sizes of the keys are looked at."""
    sums, carries = sums or {}, carries or {}
    order_cols = _columns(order)
    if spread is None:
        spread = any_group_over(df, keys)
    if not spread:
        return _windowed(df, keys, order_cols, sums, carries)
    return _blocked(df, keys, order_cols, sums, carries)


def _windowed(df, keys, order, sums, carries) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return df.select(
        "*",
        *[F.sum(e).over(upto).alias(n) for n, e in sums.items()],
        *[F.last(e, ignorenulls=True).over(before).alias(n) for n, e in carries.items()],
    )


def _blocked(df, keys, order, sums, carries) -> DataFrame:
    """Range-sorted blocks.  The checkpoint fixes which block a row is in, so the block
    totals and the rows they are added to always agree, also after a lost executor."""
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_block", F.spark_partition_id())
    rows = freeze(ranged)
    inner = Window.partitionBy(*keys, "_block").orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    local = _windowed(rows, [*keys, "_block"], order, sums, carries)

    # what each block of a key hands on to the next one: its last row's running values
    ends = rows.select(
        *keys,
        "_block",
        F.lead(F.lit(1)).over(inner).alias("_more"),
        *[F.sum(e).over(upto).alias(n) for n, e in sums.items()],
        *[F.last(e, ignorenulls=True).over(upto).alias(n) for n, e in carries.items()],
    ).filter(F.col("_more").isNull())
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_block").alias("_b"),
        F.count(F.lit(1)).over(across).alias("_earlier"),
        *[F.sum(n).over(across).alias(f"_s_{n}") for n in sums],
        *[F.last(n, ignorenulls=True).over(across).alias(f"_c_{n}") for n in carries],
    ).filter(F.col("_earlier") > 0)
    # Sorted by key, a block continues at most one key of the block before it: ``handed``
    # has fewer rows than there are blocks, whatever the data, so it is safe to broadcast.
    match = [local["_block"] == F.col("_b")] + [local[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = local.join(F.broadcast(handed), reduce(lambda a, b: a & b, match), "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_s_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(F.col(n), F.col(f"_c_{n}")).alias(n) for n in carries],
    )


def row_numbers(
    df: DataFrame, keys: list[str], order: list[Column | str], name: str, spread: bool | None = None
) -> DataFrame:
    """One-based position of each row within its key."""
    return ordered_scan(df, keys, order, sums={name: F.lit(1).cast("bigint")}, spread=spread)


def islands(
    df: DataFrame, keys: list[str], order: list[Column | str], value: str, gap: Column, name: str, spread: bool | None = None
) -> DataFrame:
    """Number runs of rows; ``gap`` (over ``_previous``, the value one row back) starts a new run."""
    spread = any_group_over(df, keys) if spread is None else spread
    seen = ordered_scan(df, keys, order, carries={"_previous": F.struct(F.col(value).alias("v"))}, spread=spread)
    seen = seen.withColumn("_previous", F.col("_previous.v"))
    opened = seen.withColumn("_open", F.when(F.col("_previous").isNull() | gap, 1).otherwise(0).cast("bigint"))
    return ordered_scan(opened, keys, order, sums={name: F.col("_open")}, spread=spread).drop("_open", "_previous")


def first_per_key(df: DataFrame, keys: list[Column], order: list[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key.  Spark limits each group inside every map task
    before the shuffle, so a hot key sends at most ``n`` rows per task."""
    w = Window.partitionBy(*keys).orderBy(*_columns(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")

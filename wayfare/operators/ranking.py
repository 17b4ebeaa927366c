"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.session import stage

# Rows of a group that one task sorts by itself.
GROUP = 1_000_000


def number_within(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Number rows 1, 2, … by ``order`` (NULLs last) within each group of ``keys``.

    A group of up to ``GROUP`` rows is sorted in one task, by a window over the groups as they are
    dealt, so that rows which come dealt by ``keys`` are not moved again. Larger groups, of which there
    are few by arithmetic, are cut into slices. ``keys`` and ``order`` together must identify a row;
    rows with a NULL key are left out.

    The groups are counted first, which reads the keys of ``df`` once more. So a ``df`` that is
    costly to work out is best staged.
    """
    rows = df.dropna(subset=keys)
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_rows"))
    large = stage(counted.filter(F.col("_rows") > GROUP).select(*keys), "large-groups")
    if large.isEmpty():
        return _in_one_task(rows, keys, order, out)
    rows = stage(rows, "to-number")
    small = rows.join(F.broadcast(large), keys, "left_anti").select(*df.columns)
    cut = rows.join(F.broadcast(large), keys, "left_semi").select(*df.columns)
    return _in_one_task(small, keys, order, out).unionByName(_in_slices(cut, keys, order, out))


def _by(order: list[str]) -> list:
    return [F.col(c).asc_nulls_last() for c in order]


def _in_one_task(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*_by(order)))
    return df.select("*", place.cast("bigint").alias(out))


def _in_slices(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Spark's range partitioning sorts the rows, cutting a large group into several slices. Positions
    run on within a slice, so its first position and the sizes of the slices before it give a row its
    number, without another sort.

    Range partitioning reads its input twice, so ``df`` is best staged. The sorted rows are staged
    here, because their positions must not change between the two uses.
    """
    by = [*keys, *_by(order)]
    placed = stage(
        df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()),
        "numbered",
    ).withColumn("_slice", F.shiftright("_at", 33))

    # Only a group that crosses a partition boundary needs an offset, so the offsets are fewer
    # than twice the partitions of the sort.
    slices = placed.groupBy(*keys, "_slice").agg(F.count("*").alias("_rows"), F.min("_at").alias("_start"))
    crossing = slices.groupBy(*keys).agg(F.min("_slice").alias("_first"), F.max("_slice").alias("_last"))
    crossing = crossing.filter(F.col("_first") < F.col("_last")).select(*keys)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.join(crossing, keys, "left_semi").select(
        *keys, "_slice", F.sum("_rows").over(earlier).alias("_before")
    )
    starts = slices.join(offsets, [*keys, "_slice"], "left").selectExpr(
        *keys, "_slice", "_start - coalesce(_before, 0) - 1 as _zero"
    )
    numbered = placed.join(starts, [*keys, "_slice"])
    return numbered.withColumn(out, F.col("_at") - F.col("_zero")).select(*df.columns, out)

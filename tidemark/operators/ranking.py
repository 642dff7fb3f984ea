"""Ranked selection per group, safe when one group holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

LANES = 64
#: Ranges that a group is cut into where its limit is in the thousands; only cost depends on them.
RANGES = 64
LARGE_LIMIT = 4096


def top_per_group(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    limit: int,
    rank: str | None = None,
    lanes: int = LANES,
    measure: Column | None = None,
) -> DataFrame:
    """The first `limit` rows of each group; `order` must be a total order.

    `measure` is a number that never falls along `order` and is never null. With it, a limit of
    `LARGE_LIMIT` or more goes by ranges (`_by_ranges`); the rows are then read three times, so
    they should be stored.

    Two steps: every group is first cut to `limit` rows in each of `lanes`
    lanes, then across them. A lane is the input partition modulo `lanes`, so
    the first cut already happens before any row is sent, and the last task of
    a group sees at most lanes * limit rows. The outcome does not depend on how
    rows fall into lanes.
    """
    if measure is not None and limit >= LARGE_LIMIT:
        return _by_ranges(rows, group, order, limit, rank, lanes, measure)
    lane, place = "_lane", rank or "_place"
    by_lane = Window.partitionBy(*group, lane).orderBy(*order)
    by_group = Window.partitionBy(*group).orderBy(*order)
    ranked = (
        rows.withColumn(lane, F.spark_partition_id() % lanes)
        .withColumn("_lane_place", F.row_number().over(by_lane))
        .filter(F.col("_lane_place") <= limit)
        .drop("_lane_place", lane)
        .withColumn(place, F.row_number().over(by_group))
        .filter(F.col(place) <= limit)
    )
    return ranked if rank else ranked.drop(place)


def _with(rows: DataFrame, facts: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Rows with the facts of their key; null is a key like any other."""
    named = facts.select(*[F.col(c).alias(f"_of_{c}" if c in keys else c) for c in facts.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys])
    return rows.join(named, same, how).drop(*[f"_of_{c}" for c in keys])


def cut_ranges(
    rows: DataFrame, group: Sequence[str], measure: Column, limit: int, ranges: int = RANGES
) -> tuple[DataFrame, DataFrame]:
    """Bounds of about equally full ranges of each group of more than `limit` rows, and the ranges that
    the first `limit` rows reach into, with the number of rows before them.

    Bounds are quantiles of a sketch, so they are near only; the counts are exact. Groups of no more
    than `limit` rows need none, so there are fewer bounds than rows / limit, and both tables can be
    broadcast: a join by group would send all rows of a hot group to one task."""
    narrow = rows.select(*group, measure.cast("double").alias("_measure"))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = narrow.groupBy(*group).agg(
        F.percentile_approx("_measure", shares, 32 * ranges).alias("_bounds"), F.count("*").alias("_size")
    )
    bounds = bounds.filter(F.col("_size") > limit).drop("_size")
    counts = _in_range(_with(narrow, F.broadcast(bounds), group, "inner")).groupBy(*group, "_range").count()
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*group, "_range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    return bounds, before.filter(F.col("_before") < limit)


def _in_range(rows: DataFrame) -> DataFrame:
    """Rows with their range; those of a group without bounds are in no range but 0."""
    below = F.filter("_bounds", lambda bound: bound < F.col("_measure"))
    place = F.when(F.col("_bounds").isNull(), 0).otherwise(F.size(below))
    return rows.withColumn("_range", place).drop("_bounds", "_measure")


def _by_ranges(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    limit: int,
    rank: str | None,
    lanes: int,
    measure: Column,
) -> DataFrame:
    """As top_per_group, for limits that one task of a group should not meet.

    Rows are counted by range of the measure first, from the group's columns and the measure alone;
    whole rows are only sent if their range reaches into the limit, and each range is ranked by
    itself, so a hot group is spread over its ranges. Rows of one measure share a range, and are cut
    by lanes there. Groups of no more than `limit` rows are kept whole."""
    bounds, reached = cut_ranges(rows, group, measure, limit)
    measured = _with(rows.withColumn("_measure", measure.cast("double")), F.broadcast(bounds), group, "left")
    placed = _in_range(measured.withColumn("_cut", F.col("_bounds").isNotNull()))
    met = _with(placed, F.broadcast(reached), [*group, "_range"], "left")
    near = met.filter(~F.col("_cut") | F.col("_before").isNotNull()).withColumn("_before", F.coalesce("_before", F.lit(0))).drop("_cut")
    inside = top_per_group(near, [*group, "_range"], order, limit, "_inside", lanes)
    place = rank or "_place"
    ranked = inside.withColumn(place, (F.col("_before") + F.col("_inside")).cast("int")).filter(F.col(place) <= limit)
    return ranked.drop("_range", "_before", "_inside", *([] if rank else [place]))


def first_per_group(rows: DataFrame, group: Sequence[str], best: Column) -> DataFrame:
    """The row with the greatest `best` in each group, as an aggregate."""
    rest = [c for c in rows.columns if c not in group]
    return (
        rows.groupBy(*group)
        .agg(F.max_by(F.struct(*rest), best).alias("_row"))
        .select(*group, "_row.*")
    )

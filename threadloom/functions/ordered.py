"""Numbers and neighbours along a global order, without a window over all rows.

Spark deals the rows to ranges of the order, each range is sorted where it is, and only one figure a range (how many rows
it holds) travels any further.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: monotonically_increasing_id() counts a partition's rows in its lowest 33 bits.
_PLACES = 33


def number_rows(rows: DataFrame, order: list[Column], keep: Callable[[DataFrame], DataFrame], name: str = "number") -> DataFrame:
    """Append ``name`` (long): 1, 2, 3, ... along ``order`` over all rows.

    ``keep`` stores a table once and returns the stored one, since ranges are drawn from a sample and must not be drawn
    twice (``checkpoint``, or a table written to a shared folder). Rows that are equal in ``order`` get different
    numbers, in no set order: end ``order`` with what tells them apart, where it matters. ``name`` replaces a column of
    that name; no rows stay no rows. The one window that isn't split reads a row for each range.
    """
    ranged = rows.drop(name).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = keep(ranged.withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", _PLACES)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    # a row for each range: bounded by the number of shuffle partitions
    joined = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    within = F.col("__place").bitwiseAND(F.lit((1 << _PLACES) - 1))
    return joined.withColumn(name, (F.col("__before") + within + 1).cast("long")).drop("__part", "__place", "__rows", "__before")


def lower_medians(rows: DataFrame, keys: list[str], value: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(keys, lower_median): of each group the value that half of its rows, rounded up, don't exceed. Nulls don't count, and
    a group without values has no row; null keys are a group.

    Values are counted, then the counts are summed along the order of all groups and values, range by range. So neither a
    group of all rows nor one with as many values as rows is ever in one task.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__value")).agg(F.count("*").alias("__count"))
    summed = running_sum(counts, [*[F.asc_nulls_first(k) for k in keys], F.asc("__value")], "__count", keep, "__upto")
    group = F.struct(*keys) if keys else F.lit(1)
    summed = summed.withColumn("__group", F.xxhash64(group))
    ends = summed.groupBy("__group", *keys).agg(F.min(F.col("__upto") - F.col("__count")).alias("__from"), F.sum("__count").alias("__rows"))
    named = ends.select(F.col("__group").alias("__of"), F.struct(F.lit(0), *keys).alias("__key"), "__from", "__rows")
    met = summed.join(named, (F.col("__group") == F.col("__of")) & F.struct(F.lit(0), *keys).eqNullSafe(F.col("__key")))
    middle = F.col("__from") + F.shiftright(F.col("__rows") + 1, 1)
    return met.where((F.col("__upto") >= middle) & (F.col("__upto") - F.col("__count") < middle)).select(*keys, F.col("__value").alias("lower_median"))


def running_sum(rows: DataFrame, order: list[Column], amount: str, keep: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Append ``name`` (long): the sum of ``amount`` of all rows up to this one along ``order``, over all ranges."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = keep(ranged.withColumn("__place", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__place", _PLACES))
    parts = placed.groupBy("__part").agg(F.sum(amount).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    offsets = parts.select("__part", before.alias("__before"))
    inner = F.sum(amount).over(Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0))
    joined = placed.withColumn("__inner", inner).join(F.broadcast(offsets), "__part")
    return joined.withColumn(name, (F.col("__before") + F.col("__inner")).cast("long")).drop("__part", "__place", "__inner", "__before")


def nearest_others(rows: DataFrame, order: list[Column], within: list[str], kind: list[str], value: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Append ``before`` and ``after``: ``value`` of the nearest row on either side of ``order`` that is in the same
    group (``within``) and of another ``kind``; null where there is none.

    ``order`` begins with the columns of ``within``, so groups stand together; nulls count as equal. Rows of one kind may
    stand in a run over many ranges. What a range's first and last runs need from other ranges is carried over in a table
    with a row for each range; ``keep`` is as in ``number_rows``. Columns named ``before`` and ``after`` are replaced.
    """
    rows = rows.drop("before", "after")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = keep(ranged.withColumn("__place", F.monotonically_increasing_id()))
    here = F.struct(F.struct(*within).alias("group"), F.struct(*kind).alias("kind"), F.col(value).alias("value"))
    placed = placed.withColumn("__part", F.shiftright("__place", _PLACES)).withColumn("__here", here)
    out = placed
    for name, forward in (("before", True), ("after", False)):
        by = Window.partitionBy("__part").orderBy("__place" if forward else F.desc("__place"))
        last = F.lag("__here").over(by)
        # the row passed last, where this one is of another run
        passed = F.when(last.isNotNull() & ~_same_run(last, F.col("__here")), last)
        inner = F.last("__passed", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("__passed", passed).withColumn(f"__{name}", inner).drop("__passed")
    columns = rows.columns
    for name, forward in (("before", True), ("after", False)):
        enter, leave = (F.min_by, F.max_by) if forward else (F.max_by, F.min_by)
        ends = out.groupBy("__part").agg(enter("__here", "__place").alias("enter"), leave("__here", "__place").alias("leave"), leave(f"__{name}", "__place").alias("inner"))
        parts = Window.orderBy("__part" if forward else F.desc("__part"))  # a row for each range
        left, left_inner = F.lag("leave").over(parts), F.lag("inner").over(parts)
        step = F.when(left.isNotNull(), F.when(~_same_run(left, F.col("enter")), left).otherwise(left_inner))
        carried = ends.withColumn("__step", step).select("__part", F.last("__step", ignorenulls=True).over(parts.rowsBetween(Window.unboundedPreceding, 0)).alias("__carried"))
        out = out.join(carried, "__part").withColumn(f"__{name}", F.coalesce(f"__{name}", "__carried")).drop("__carried")
        there = F.col(f"__{name}")
        out = out.withColumn(name, F.when(there["group"].eqNullSafe(F.col("__here")["group"]), there["value"]))
    return out.select(*columns, "before", "after")


def _same_run(a: Column, b: Column) -> Column:
    return a["group"].eqNullSafe(b["group"]) & a["kind"].eqNullSafe(b["kind"])

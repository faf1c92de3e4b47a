"""Summaries of a column of numbers: spread, bands and signs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.names import COUNT_BANDS, band
from threadloom.functions.ordered import lower_medians
from threadloom.session import materialize

#: Bands of the size of a ratio, as (label, times of the numerator, times of the denominator).
RATIO_BANDS = (("<=0.05", 20, 1), ("<=0.25", 4, 1), ("<=0.5", 2, 1), ("<=0.95", 20, 19))
#: Bands of the size of a difference.
DIFFERENCE_BANDS = (("<=1", 1), ("<=2", 2), ("<=5", 5), ("<=10", 10), ("<=25", 25), (">25", None))


def counted(test: Column) -> Column:
    return F.count(F.when(test, 1))


def _summary(rows: DataFrame, keys: list[str], value: str, kind: str, counts: list[Column]) -> DataFrame:
    """Per key the population, least, lower median (as ``kind``) and most of ``value``, and ``counts``.

    The rows are written once and read twice, since a median isn't a sum over tasks.
    """
    rows = materialize(rows, "summary")
    ends = [F.count(value).alias("population"), F.coalesce(F.min(value), F.lit(0)).alias("least"), F.coalesce(F.max(value), F.lit(0)).alias("most")]
    out = rows.groupBy(*keys).agg(*ends, *counts)
    medians = lower_medians(rows, keys, value, materialize).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    middle = F.coalesce(F.col("lower_median").cast(kind), F.lit(0)).alias("lower_median")
    return out.join(medians, same, "left").select(*keys, "population", "least", middle, "most", *[f"`{c}`" for c in out.columns[len(keys) + 3 :]])


def count_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: population, least, lower median, most, and how many values each of the six bands has."""
    banded = rows.select(*keys, value, band(F.col(value), COUNT_BANDS).alias("_band"))
    return _summary(banded, keys, value, "long", [counted(F.col("_band") == label).alias(f"band {label}") for label, _ in COUNT_BANDS])


def ratio_summary(rows: DataFrame, keys: list[str], numerator: str, denominator: str) -> DataFrame:
    """Per key, of whole numbers (the denominator positive): the spread of their ratio cut off after 12 decimals, its
    signs, and bands of its size by comparison of the whole numbers."""
    size, below = F.abs(F.col(numerator)), F.col(denominator)
    label = F.when(size == 0, "0")
    for name, a, b in RATIO_BANDS:
        label = label.when(size * a <= below * b, name)
    label = label.when(size < below, "<1").when(size == below, "1").otherwise(">1")
    names = ["0", *[n for n, _, _ in RATIO_BANDS], "<1", "1", ">1"]
    reading = F.expr(f"cast(sign({numerator}) * (abs({numerator}) * 1000000000000 div {denominator}) as double) / 1e12")
    banded = rows.select(*keys, F.sign(numerator).alias("_sign"), label.alias("_band"), reading.alias("_reading"))
    signs = [counted(F.col("_sign") < 0).alias("negative"), counted(F.col("_sign") == 0).alias("zero"), counted(F.col("_sign") > 0).alias("positive")]
    return _summary(banded, keys, "_reading", "double", [*signs, *[counted(F.col("_band") == n).alias(f"size {n}") for n in names[1:]]])


def difference_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: the spread of a signed difference, its signs, and bands of its size."""
    banded = rows.select(*keys, value, band(F.abs(F.col(value)), DIFFERENCE_BANDS).alias("_band"))
    signs = [counted(F.col(value) < 0).alias("negative"), counted(F.col(value) == 0).alias("zero"), counted(F.col(value) > 0).alias("positive")]
    kind = rows.schema[value].dataType.simpleString()
    return _summary(banded, keys, value, kind, [*signs, *[counted(F.col("_band") == n).alias(f"size {n}") for n, _ in DIFFERENCE_BANDS]])

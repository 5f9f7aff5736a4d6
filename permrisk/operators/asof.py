"""Point-in-time aggregates and lookups that stay linear.

Facts are first added up by key and day with map-side combining, so what is
sorted afterwards has at most one row for each key and day, however many facts
there are. Running sums over those days and the days asked about turn every
as-of question into an equi-join on (key, day): no range join, and nothing on
or after the day is seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(
    facts: DataFrame, keys: list[str], day: str, sums: dict[str, Column], lasts: dict[str, Column], asked: DataFrame, *, most: dict[str, Column] | None = None, least: dict[str, Column] | None = None
) -> DataFrame:
    """For each (key, day) of ``asked``: totals of ``sums`` over all earlier days, the latest ``lasts`` of an earlier day, and extremes of ``most`` and ``least``.

    ``asked`` has the keys and a column ``day``; null days ask nothing, facts without a day are not seen by any.
    """
    most, least = most or {}, least or {}
    daily = facts.where(F.col(day).isNotNull()).groupBy(*keys, F.col(day).alias("__day")).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()], *[c.alias(n) for n, c in lasts.items()], *[F.max(c).alias(n) for n, c in most.items()], *[F.min(c).alias(n) for n, c in least.items()]
    )
    days = asked.where("day IS NOT NULL").select(*keys, F.col("day").alias("__day"), F.lit(True).alias("__asked")).distinct()
    both = daily.join(days, [*keys, "__day"], "full")
    before = Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    state = both.select(*keys, F.col("__day").alias(day), "__asked", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums], *[F.last(n, ignorenulls=True).over(before).alias(n) for n in lasts], *[F.max(n).over(before).alias(n) for n in most], *[F.min(n).over(before).alias(n) for n in least])
    return state.where("__asked").drop("__asked")


def moments(subjects: DataFrame, keys: list[str], *at: Column) -> DataFrame:
    """The (key, day) pairs that subjects ask about."""
    return subjects.select(*keys, F.explode(F.array(*at)).alias("day"))


def look_up(subjects: DataFrame, state: DataFrame, keys: list[str], at: Column, day: str, prefix: str, names: list[str]) -> DataFrame:
    """``state`` as it was at ``at`` for each subject; null where the day was not asked about."""
    held = state.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(day).alias("__day"), *[F.col(n).alias(prefix + n) for n in names])
    on = (F.col("__day") == at) & F.lit(True)
    for k in keys:
        on = on & (F.col(f"__{k}") == subjects[k])
    return subjects.join(held, on, "left").drop("__day", *[f"__{k}" for k in keys])

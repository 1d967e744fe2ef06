"""Quantile summaries by the exclusive method, and counts over closed domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import exact_round


def quantile_summary(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, min, p10, median, p90, max), rounded to 4 places; position p * (n + 1), one row stands for all of its quantiles.

    Equal values are counted before they are ordered, so that a window task holds a group's distinct values, not its rows.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("v")).count()
    upto = F.sum("count").over(Window.partitionBy(group).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    run = counted.withColumn("upto", upto).withColumn("n", F.sum("count").over(Window.partitionBy(group)))

    def at(position):
        return F.min(F.when(F.col("upto") >= position, F.col("v")))

    def lower(k):
        return F.greatest(F.lit(1), F.least(F.floor(F.col("n") * k / 10 + F.lit(k) / 10), F.col("n") - 1))

    picked = [x.alias(f"q{k}{side}") for k in (1, 5, 9) for side, x in (("a", at(lower(k))), ("b", at(lower(k) + 1)))]
    found = run.groupBy(group, "n").agg(F.min("v").alias("low"), F.max("v").alias("high"), *picked)

    def quantile(k):
        share = F.col("n") * k / 10 + F.lit(k) / 10 - lower(k)
        return F.when(F.col("n") == 1, F.col("low")).otherwise(F.col(f"q{k}a") * (1 - share) + F.col(f"q{k}b") * share)

    return found.select(group, "n", exact_round(F.col("low"), 4).alias("min"), *[exact_round(quantile(k), 4).alias(c) for k, c in ((1, "p10"), (5, "median"), (9, "p90"))], exact_round(F.col("high"), 4).alias("max"))


def closed_counts(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """(value, n) for each value of a closed domain, zeros kept; one pass, one row for each task."""
    counts = rows.agg(*[F.count_if(F.col(column) == v).alias(v) for v in domain])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(v).alias("value"), F.col(f"`{v}`").alias("n")) for v in domain])).alias("x")).select("x.*")

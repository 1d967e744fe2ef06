"""Leakage-free splits by speaker, and the check for leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.shared import kept

#: Buckets of the speakers' hash order: running sums are made within a bucket and over the buckets' totals (16 ** BUCKET_DIGITS of them at most).
BUCKET_DIGITS = 3
#: The speaker that can't be told apart, and what a row without a duration counts.
UNKNOWN, NO_DURATION = "unknown", 1


def speaker_map(rows: DataFrame, speaker: str, duration: str, test: float = 0.1, validation: float = 0.1, seed: int = 13) -> DataFrame:
    """(speaker, split) of the known speakers.

    In the order of a hash of seed and speaker, speakers go to test until it has its share of the duration, then to validation, the rest to train.
    Null speakers are the empty name; a duration that is null, no number or 0 counts NO_DURATION for its row. Durations add up as decimals, so the result
    doesn't depend on the order. The rows are read once: one small table of speakers is kept. Running sums go by buckets of the hash, so no task orders all speakers.
    """
    name = F.coalesce(F.col(speaker).cast("string"), F.lit(""))
    seconds = F.col(duration).cast("string").try_cast("decimal(18,3)")
    weight = F.when(F.coalesce(seconds, F.lit(0)) == 0, F.lit(NO_DURATION).cast("decimal(18,3)")).otherwise(seconds)
    each = rows.select(name.alias("speaker"), weight.alias("weight")).filter(F.col("speaker") != UNKNOWN).groupBy("speaker").agg(F.sum("weight").alias("own"))
    each = each.withColumn("order", F.md5(F.concat(F.lit(str(seed)), "speaker"))).withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS))
    each = kept(each, "speakers")
    totals = each.groupBy("bucket").agg(F.sum("own").alias("bucket_sum"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = totals.select("bucket", (F.sum("bucket_sum").over(upto) - F.col("bucket_sum")).alias("ahead"), F.sum("bucket_sum").over(whole).alias("total"))
    inside = Window.partitionBy("bucket").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    run = each.withColumn("inside", F.sum("own").over(inside)).join(F.broadcast(ahead), "bucket").withColumn("before", F.col("ahead") + F.col("inside") - F.col("own"))
    share = lambda x: F.col("total") * F.lit(str(x)).cast("decimal(9,6)")
    in_test = F.col("before") < share(test)
    test_end = run.filter(in_test).agg(F.coalesce(F.max(F.col("before") + F.col("own")), F.lit(0)).alias("test_end"))
    in_validation = F.col("before") - F.col("test_end") < share(validation)
    return run.crossJoin(F.broadcast(test_end)).select(F.col("speaker").alias(speaker), F.when(in_test, "test").when(in_validation, "validation").otherwise("train").alias("split"))  # one row


def assigned(rows: DataFrame, speaker: str, duration: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 13) -> DataFrame:
    """rows with their split (an old one goes); unknown speakers are in train, as they can't be told apart. ratios: train, validation, test."""
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("ratios must add up to 1")
    found = speaker_map(rows, speaker, duration, ratios[2], ratios[1], seed).select(F.col(speaker).alias("_speaker"), "split")
    joined = rows.drop("split").withColumn("_name", F.coalesce(F.col(speaker).cast("string"), F.lit(""))).join(found, F.col("_name") == F.col("_speaker"), "left")
    return joined.withColumn("split", F.coalesce("split", F.lit("train"))).drop("_name", "_speaker")


def leaks(rows: DataFrame, speaker: str, split: str) -> DataFrame:
    """(speaker, splits) of the speakers in more than one split."""
    found = rows.groupBy(speaker).agg(F.array_sort(F.collect_set(split)).alias("found"))
    return found.filter("size(found) > 1").select(speaker, F.array_join("found", ";").alias("splits"))

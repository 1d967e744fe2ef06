"""Order-dependent operators over append-only logs and keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_wins(log: DataFrame, key: str | list[str], order: Column, keep: Column | None = None) -> DataFrame:
    """The last row of each key, and of these the rows where keep holds: a later failure hides an earlier success.

    An aggregate with map-side combining, so that a key with a third of all rows is one row for each task. Select the columns that are needed first.
    """
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, *[F.col("_last")[c].alias(c) for c in rest]).select(*log.columns)
    return last if keep is None else last.filter(keep)


def any_ok(log: DataFrame, key: str, ok: Column) -> DataFrame:
    """The keys with at least one row where ok holds."""
    return log.filter(ok).select(key).distinct()


def to_do(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """tasks whose key isn't in done."""
    return tasks.join(done.select(key), key, "left_anti")


def retried(tasks: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """tasks whose key is in failed."""
    return tasks.join(failed.select(key), key, "left_semi")


def keep_last_at_first(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key that is neither null nor empty, with the place of its first as `place`."""
    rest = [c for c in log.columns if c != key]
    found = log.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last"), F.min(seq).alias("place"))
    return found.select(key, *[F.col("_last")[c].alias(c) for c in rest], "place").select(*log.columns, "place")


def moved_to_end(old: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """old without the keys of new, then new: a replaced row moves to the end. seq is the order; new's follows old's."""
    last = F.broadcast(old.agg(F.coalesce(F.max(seq), F.lit(0)).alias("_end")))
    kept = old.join(new.select(key), key, "left_anti")
    added = new.crossJoin(last).withColumn(seq, F.col(seq) + F.col("_end")).drop("_end")  # one row
    return kept.unionByName(added)


def appended(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old, then the rows of new whose key old lacks; nothing of old is overwritten. Repeats within new stay, for a validator to find."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, key: str, preserved: str, seq: str | None = None) -> DataFrame:
    """old with new's rows in place of its own, but with old's value of one column.

    seq: a column with the order. A replaced row keeps its old place, new rows follow in their order.
    """
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    is_new, is_old = F.col(f"b.{key}").isNotNull(), F.col(f"a.{key}").isNotNull()
    value = {c: F.when(is_new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) for c in old.columns}
    value[preserved] = F.when(is_old, F.col(f"a.{preserved}")).otherwise(F.col(f"b.{preserved}"))
    if seq is None:
        return both.select(*[v.alias(c) for c, v in value.items()])
    end = F.broadcast(old.agg(F.coalesce(F.max(seq), F.lit(0)).alias("_end")))
    value[seq] = F.when(is_old, F.col(f"a.{seq}")).otherwise(F.col(f"b.{seq}") + F.col("_end"))
    return both.crossJoin(end).select(*[v.alias(c) for c, v in value.items()])  # one row


def reused(plan: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """The planned chunks with done's prediction; reused says whether there is one, the others are to be made."""
    found = done.select(*key, F.col("prediction"), F.lit(True).alias("reused"))
    return plan.join(found, key, "left").withColumn("reused", F.coalesce("reused", F.lit(False)))

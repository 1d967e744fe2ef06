"""Consecutive numbers in a global order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the order; their sizes are one small table.
PARTS = 64


def numbered(rows: DataFrame, order: str, name: str, start: int = 1) -> DataFrame:
    """rows with `name`: start, start + 1, ... in the order of the column order (its values should differ).

    Bounds from a sample of the order (sorted in the driver, PARTS of them whatever the input) deal the rows into parts, each part numbers its own,
    and the parts' sizes shift them. The bounds only balance the parts: any bounds give the same numbers.
    """
    sample = rows.select(order).orderBy(F.xxhash64(order)).limit(PARTS * 32).select(order).collect()
    cuts = sorted((r[0] for r in sample if r[0] is not None), key=_sortable)
    cuts = cuts[:: max(1, len(cuts) // PARTS)]
    bounds = rows.sparkSession.createDataFrame([(c,) for c in cuts], rows.select(order).schema).select(F.sort_array(F.collect_list(order)).alias("_cuts"))
    part = F.size(F.filter("_cuts", lambda c: c <= F.col(order)))
    dealt = rows.crossJoin(F.broadcast(bounds)).withColumn("_part", part).drop("_cuts")  # one row of bounds
    sizes = dealt.groupBy("_part").count()
    ahead = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order)).cast("long")
    return dealt.withColumn(name, own).join(F.broadcast(ahead), "_part").withColumn(name, F.col(name) + F.col("_ahead") + (start - 1)).drop("_part", "_ahead")


def _sortable(value):
    return tuple(value) if hasattr(value, "asDict") else value


def numbered_in_groups(rows: DataFrame, group: str, order: str, name: str, start: int = 0) -> DataFrame:
    """rows with `name`: start, start + 1, ... within each group, for groups of bounded size (the segments of a chapter)."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(order)) + (start - 1))


def sequence_id(prefix, number, digits: int = 3, mark: str = "_"):
    """prefix, a mark, and a number with leading zeros."""
    return F.concat(prefix, F.lit(mark), F.format_string(f"%0{digits}d", number.cast("long")))

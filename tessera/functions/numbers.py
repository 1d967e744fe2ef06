"""Rounding by the exact binary value, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_round(value: Column, places: int) -> Column:
    """value rounded to places by its exact binary value, ties to the even digit; meant for |value| * 10**places under 2**52.

    The product with 10**places and its rounding error (splitting value in two halves) are both exact, so a value just under or over a tie is told
    from one on it. Null stays null, NaN and infinities stay what they are.
    """
    scale = float(10**places)
    x = F.abs(value)
    big = x * 134217729.0
    high = big - (big - x)
    product = x * scale
    error = (high * scale - product) + (x - high) * scale
    down = F.floor(product).cast("double")
    beyond = (product - down - 0.5) + error
    up = (beyond > 0) | ((beyond == 0) & (F.pmod(down, F.lit(2.0)) == 1))
    whole = F.when(up, down + 1).otherwise(down) / scale
    plain = F.isnan(value) | (x >= float(2**52) / scale)
    return F.when(plain, value).otherwise(F.when(value < 0, -whole).otherwise(whole))


def rounded(columns: dict[str, Column], places: int = 4) -> dict[str, Column]:
    return {k: exact_round(v, places) for k, v in columns.items()}

"""Sheets of prompts for recording sessions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.numbering import numbered


def scope(raw: str) -> tuple[list[str], list[str]]:
    """(crops, those that are always in) of a JSON object."""
    found = json.loads(raw)
    return found["crops"], found.get("always_include", ["general"])


def session_sheet(prompts: DataFrame, crops: list[str], always: list[str], rewritten: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """(sheet in the file's order, prompts that are skipped as they are to be read and aren't rewritten yet).

    rewritten: the column with a native speaker's form of a prompt; a draft is never read out in its place.
    """
    inside = prompts.filter(F.col("crop").isin(*crops, *always))
    is_read = F.coalesce(F.col("type") == "read", F.lit(False))
    wanting = is_read & text.is_blank(F.col(rewritten))
    kept = numbered(inside.filter(~wanting), seq, "order")
    shown = F.when(is_read, F.col(rewritten)).otherwise(F.col("text"))
    sheet = kept.select("order", "prompt_id", "type", "topic", "crop", shown.alias("show_text"), F.when(is_read, F.col(rewritten)).otherwise("").alias("expected_read_text"), F.lit("").alias("recording_file"), F.lit("").alias("notes"))
    return sheet, inside.filter(wanting).select("prompt_id")

"""Triage of candidate segments from raw inputs: signals, components, confidence, flags and status, and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scores, text
from tessera.functions.numbers import exact_round
from tessera.functions.scores import DEFAULTS, TriageSettings
from tessera.operators import summaries, word_edits

#: The components' names in their order, statuses, and what is summarised.
COMPONENTS = ("alignment", "agreement", "audio_quality", "duration", "speaking_rate")
STATUSES = ("HIGH_CONFIDENCE_CANDIDATE", "NEEDS_REVIEW", "REJECT_CANDIDATE")
SUMMARISED = ("confidence_score", *[f"{c}_score" for c in COMPONENTS], "duration_sec", "chars_per_sec", "cer_vs_asr")


def text_signals(rows: DataFrame, candidate: str, asr: str, keep: list[str]) -> DataFrame:
    """keep, cer_vs_asr, insert_delete_rate, substitutions, deletions, insertions. Where either side has no words: rates of 1, counts of 0."""
    plain = rows.withColumns({"_r": text.strip_punctuation(F.coalesce(candidate, F.lit(""))), "_h": text.strip_punctuation(F.coalesce(asr, F.lit("")))})
    plain = plain.withColumns({"_none": (F.col("_r") == "") | (F.col("_h") == ""), "_cer": text.error_rate(F.col("_r"), F.col("_h"))})
    counts = word_edits.counted(plain, F.col("_r"), F.col("_h"), [*keep, "_none", "_cer"])
    n = F.expr("hits + substitutions + deletions")
    rates = {"cer_vs_asr": F.when(F.col("_none"), 1.0).otherwise(F.col("_cer")), "insert_delete_rate": F.when(F.col("_none"), 1.0).otherwise(F.expr("insertions + deletions") / F.greatest(n, F.lit(1)))}
    zeroed = {c: F.when(F.col("_none"), 0).otherwise(F.col(c)).cast("long") for c in ("substitutions", "deletions", "insertions")}
    return counts.withColumns(rates | zeroed).drop("hits", "_none", "_cer")


def scored(rows: DataFrame, headings: DataFrame | None = None, settings: TriageSettings = DEFAULTS) -> DataFrame:
    """rows(segment_id, candidate_text, raw_asr, start_sec, end_sec, align_score, audio struct<silence_ratio, clip_ratio, rms_dbfs>) with all signals, components and the verdict, unrounded.

    Numbers may be texts; what is none is missing. headings(segment_id, n_headings): 0 where there is none. triage_flags is an array.
    """
    own = rows.columns
    number = lambda c: text.number(F.col(c).cast("string"))
    found = rows.withColumns({"candidate_text": F.coalesce("candidate_text", F.lit("")), "raw_asr": F.coalesce("raw_asr", F.lit("")), "_align": number("align_score"), "duration_sec": F.coalesce(number("end_sec") - number("start_sec"), F.lit(0.0))})
    if headings is None:
        found = found.withColumn("n_headings", F.lit(0))
    else:
        counts = headings.groupBy("segment_id").agg(F.max("n_headings").alias("n_headings"))
        found = found.join(counts, "segment_id", "left").withColumn("n_headings", F.coalesce("n_headings", F.lit(0)))
    found = text_signals(found, "candidate_text", "raw_asr", list(dict.fromkeys([*own, "_align", "duration_sec", "n_headings"])))
    found = found.withColumns({"chars_per_sec": text.speaking_rate(F.col("candidate_text"), F.col("duration_sec")), **{c: F.col(f"audio.{c}") for c in ("silence_ratio", "clip_ratio", "rms_dbfs")}})
    parts = scores.components(*map(F.col, ("duration_sec", "chars_per_sec", "_align", "cer_vs_asr", "insert_delete_rate", "silence_ratio", "clip_ratio", "rms_dbfs")), settings)
    found = found.withColumns({f"{k}_score": v for k, v in parts.items()})
    flags = F.concat(text.artifact_flags(F.col("candidate_text"), F.col("raw_asr"), F.col("n_headings")), scores.late_flags(F.col("_align"), F.col("silence_ratio"), F.col("duration_score"), F.col("speaking_rate_score"), settings))
    found = found.withColumn("triage_flags", flags)
    return found.withColumns(scores.verdict({k: F.col(f"{k}_score") for k in COMPONENTS}, F.col("triage_flags"), settings)).drop("_align")


def told(found: DataFrame) -> DataFrame:
    """scored rows as they are written: rounded, flags joined by `;`."""
    places = {"duration_sec": 3, "chars_per_sec": 2} | dict.fromkeys(("cer_vs_asr", "insert_delete_rate", "silence_ratio", "clip_ratio", "rms_dbfs", "base_confidence", "artifact_penalty", "confidence_score", *[f"{c}_score" for c in COMPONENTS]), 4)
    return found.withColumns({c: exact_round(F.col(c), n) for c, n in places.items()} | {"triage_flags": F.array_join("triage_flags", ";")})


def updated(gold: DataFrame, found: DataFrame, settings: TriageSettings = DEFAULTS) -> DataFrame:
    """gold with new triage columns for the segments of told rows; nothing else changes."""
    names = {f"{c}_score": f"{c}_score" for c in COMPONENTS} | {"artifact_score": "artifact_penalty", "confidence_score": "confidence_score", "triage_status": "triage_status", "triage_flags": "triage_flags"}
    new = found.select("segment_id", *[F.col(v).alias(f"_{k}") for k, v in names.items()], F.lit(settings.version).alias("_triage_version"))
    joined = gold.join(new, "segment_id", "left")
    values = {k: F.when(F.col("_triage_version").isNotNull(), F.col(f"_{k}").cast(gold.schema[k].dataType)).otherwise(F.col(k)) for k in [*names, "triage_version"] if k in gold.columns}
    return joined.withColumns(values).select(*gold.columns)


def status_counts(found: DataFrame) -> DataFrame:
    return summaries.closed_counts(found, "triage_status", list(STATUSES))


def review_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("review_status").agg(F.count(F.lit(1)).alias("n"))


def flag_counts(found: DataFrame) -> DataFrame:
    """(flag, n) of rows whose triage_flags are joined by `;`."""
    return found.select(F.explode(F.split("triage_flags", ";")).alias("flag")).filter("flag <> ''").groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def by_chapter(found: DataFrame, chapter: str) -> DataFrame:
    """(chapter, one column for each status), zeros kept."""
    return found.groupBy(chapter).agg(*[F.count_if(F.col("triage_status") == s).alias(s) for s in STATUSES])


def distributions(found: DataFrame) -> DataFrame:
    """(name, n, min, p10, median, p90, max) of what is summarised, all in one pass over long rows."""
    long = found.select(*[F.col(c).cast("double") for c in SUMMARISED]).unpivot([], list(SUMMARISED), "name", "value")
    return summaries.quantile_summary(long, "name", "value")

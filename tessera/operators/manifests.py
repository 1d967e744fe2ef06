"""Utterance manifests: rules, listing, upsert, leakage-free splits with their summary, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.numbers import exact_round
from tessera.operators import splits

#: The columns, the allowed values, the splits, and the source whose recordings need consent.
COLUMNS = ("utterance_id", "audio_path", "speaker_id", "district", "age_group", "gender", "duration_sec", "language", "dialect", "domain", "transcript", "transcript_status", "recording_quality", "consent_status", "source", "license", "split")
ALLOWED = {
    "domain": ("general", "scripture", "agriculture"),
    "transcript_status": ("not_available", "pending_review", "verified"),
    "recording_quality": ("good", "fair", "poor", "unchecked"),
    "consent_status": ("given", "not_applicable_published"),
    "split": ("train", "validation", "test", "unassigned"),
}
SPLITS = ("train", "validation", "test")
NATIVE = "native_recording"


class Invalid(ValueError):
    """Rows that break the rules, or speakers in several splits; nothing was written."""


def rules() -> list[tuple[str, Column]]:
    """(rule, whether a row breaks it); null counts as empty."""
    at = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return [(f"{c}_not_allowed", ~at(c).isin(*values)) for c, values in ALLOWED.items()] + [
        ("speaker_id_malformed", ~text.is_speaker(at("speaker_id"))),
        ("transcript_without_status", (at("transcript_status") == "not_available") & ~text.is_blank(F.col("transcript"))),
        ("verified_without_transcript", (at("transcript_status") == "verified") & text.is_blank(F.col("transcript"))),
        ("native_without_consent", (at("source") == NATIVE) & (at("consent_status") != "given")),
    ]


def violations(rows: DataFrame) -> DataFrame:
    """(utterance_id, error). Where columns are missing, only these are told, for each row."""
    missing = [c for c in COLUMNS if c not in rows.columns]
    key = F.col("utterance_id") if "utterance_id" in rows.columns else F.lit("?").alias("utterance_id")
    if missing:
        return rows.select(key, F.explode(F.array(*[F.lit(f"missing_{c}") for c in missing])).alias("error"))
    return rows.select(key, F.explode(F.array_compact(F.array(*[F.when(b, F.lit(n)) for n, b in rules()]))).alias("error"))


def checked(rows: DataFrame) -> DataFrame:
    """rows by utterance_id, if no rule is broken; else Invalid."""
    errors = violations(rows).limit(20).collect()
    if errors:
        raise Invalid("; ".join(f"{e['utterance_id']}: {e['error']}" for e in errors))
    return rows.orderBy("utterance_id")


def listed(files: DataFrame, prefix: str, source: str, license: str, dialect: str, language: str = "mr") -> DataFrame:
    """A manifest of published audio files(path, duration_sec): unknown speakers, no transcripts, not assigned."""
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    fixed = {"speaker_id": "unknown", "district": "unknown", "age_group": "", "gender": "", "language": language, "dialect": dialect, "domain": "scripture", "transcript": "", "transcript_status": "not_available", "recording_quality": "unchecked", "consent_status": "not_applicable_published", "source": source, "license": license, "split": "unassigned"}
    made = files.select(F.concat(F.lit(prefix), stem).alias("utterance_id"), F.col("path").alias("audio_path"), exact_round(F.col("duration_sec"), 3).alias("duration_sec"), *[F.lit(v).alias(k) for k, v in fixed.items()])
    return made.select(*COLUMNS)


def leaks(rows: DataFrame) -> DataFrame:
    """(speaker_id, splits) of known speakers in more than one of the three splits."""
    return splits.leaks(rows.filter(F.col("split").isin(*SPLITS) & (F.col("speaker_id") != "unknown")), "speaker_id", "split")


def guarded(rows: DataFrame) -> DataFrame:
    """rows, if no speaker leaks; else Invalid."""
    found = leaks(rows).limit(5).collect()
    if found:
        raise Invalid("speakers in several splits: " + ", ".join(f"{r['speaker_id']} ({r['splits']})" for r in found))
    return rows


def split_summary(rows: DataFrame) -> DataFrame:
    """(split, utterances, speakers, minutes) of each of the three splits, zeros kept."""
    at = F.col("split")
    seconds = F.sum(F.coalesce(F.col("duration_sec").cast("string").try_cast("decimal(18,3)"), F.lit(0)))
    own = rows.filter(at.isin(*SPLITS)).groupBy("split").agg(F.count(F.lit(1)).alias("utterances"), F.countDistinct("speaker_id").alias("speakers"), seconds.alias("seconds"))
    domain = rows.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    full = domain.join(own, "split", "left")
    minutes = exact_round(F.coalesce(F.col("seconds").cast("double"), F.lit(0.0)) / 60, 2)
    return full.select("split", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("utterances", "speakers")], minutes.alias("minutes"))


def statistics(rows: DataFrame) -> DataFrame:
    """(utterances, minutes, known_speakers) in one row."""
    seconds = F.sum(F.coalesce(F.col("duration_sec").cast("string").try_cast("decimal(18,3)"), F.lit(0))).cast("double")
    known = F.countDistinct(F.when(F.col("speaker_id") != "unknown", F.col("speaker_id")))
    out = rows.agg(F.count(F.lit(1)).alias("utterances"), (F.coalesce(seconds, F.lit(0.0)) / 60).alias("minutes"), known.alias("known_speakers"))
    return out.withColumn("minutes", exact_round(F.col("minutes"), 1))


def counts_by(rows: DataFrame, *columns: str) -> DataFrame:
    """(field, value, n) for several columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    return rows.select(pairs).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def problems(rows: DataFrame, gold_errors: DataFrame) -> DataFrame:
    """(kind, id, error): broken rules of the manifest, of gold(segment_id, error), and leaking speakers."""
    own = violations(rows).select(F.lit("manifest").alias("kind"), F.col("utterance_id").cast("string").alias("id"), "error")
    gold = gold_errors.select(F.lit("gold").alias("kind"), F.col("segment_id").cast("string").alias("id"), "error")
    leak = leaks(rows).select(F.lit("speaker").alias("kind"), F.col("speaker_id").alias("id"), F.concat(F.lit("in_splits:"), "splits").alias("error"))
    return own.unionByName(gold).unionByName(leak)


def dataset_counters(samples: DataFrame) -> DataFrame:
    """Counters of samples(valid, duration_sec, reference_text): total, valid, invalid, with and without a reference, minutes."""
    good, told = F.coalesce(F.col("valid"), F.lit(False)), ~text.is_blank(F.col("reference_text"))
    seconds = F.sum(F.when(good, F.col("duration_sec")))
    out = samples.agg(F.count(F.lit(1)).alias("total"), F.count_if(good).alias("valid"), F.count_if(~good).alias("invalid"), F.count_if(told).alias("with_reference"), F.count_if(~told).alias("without_reference"), (F.coalesce(seconds, F.lit(0.0)) / 60).alias("minutes"))
    return out.withColumn("minutes", exact_round(F.col("minutes"), 1))



"""Scoring of predictions against references, and comparison of runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.numbers import exact_round
from tessera.operators import logs, word_edits
from tessera.operators.numbering import numbered

#: The columns of sample scores, the labels of evaluations, the metrics that are compared.
SAMPLE_COLUMNS = ("wer", "cer", "substitutions", "deletions", "insertions", "reference_words")
LABELS = {False: "PILOT EVALUATION", True: "FINAL EVALUATION"}
METRICS = ("wer", "cer", "substitutions", "deletions", "insertions", "reference_words", "evaluated_samples", "evaluated_minutes")


class NothingScored(RuntimeError):
    """There is no reference with a prediction."""


class DifferentTestSets(ValueError):
    """Two runs were scored on different segments."""


def evaluable(predictions: DataFrame) -> DataFrame:
    """Rows with a reference that isn't blank and a prediction that went well."""
    return predictions.filter(~text.is_blank(F.col("reference")) & (F.col("status") == "ok"))


def last_of_each(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """One row a key: the last by seq."""
    return logs.latest_wins(rows, key, F.col(seq))


def with_speaker(samples: DataFrame, metadata: DataFrame, seq: str) -> DataFrame:
    """samples with speaker_id from metadata(audio_path, speaker_id, seq): the last row of a path, empty where there is none."""
    speakers = last_of_each(metadata.select("audio_path", "speaker_id", seq), "audio_path", seq).select("audio_path", "speaker_id")
    return samples.join(speakers, "audio_path", "left").withColumn("speaker_id", F.coalesce("speaker_id", F.lit("")))


def with_gold_references(predictions: DataFrame, gold: DataFrame, seq: str) -> DataFrame:
    """Predictions that went well and are in gold(audio_path, reference_text, duration_sec, speaker_id, segment_id, seq), with gold's reference and duration.

    Repeated predictions are kept, of repeated gold rows the last counts.
    """
    own = last_of_each(gold.select("audio_path", "reference_text", "duration_sec", "speaker_id", "segment_id", seq), "audio_path", seq)
    told = own.select("audio_path", F.col("reference_text").alias("reference"), "duration_sec", "speaker_id", "segment_id")
    mine = predictions.filter("status = 'ok'").drop("reference", "duration_sec", "speaker_id", "segment_id")
    return mine.join(told, "audio_path")


def sample_scores(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Scores of each row(reference, prediction), with the columns keep; texts stay as they are."""
    return word_edits.scored(rows, "reference", "prediction", keep)


def evaluation(predictions: DataFrame, metadata: DataFrame | None, model: str, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(metrics in one row, sample scores) of predictions(audio_path, reference, prediction, duration_sec, status)."""
    rows = evaluable(predictions)
    samples = sample_scores(rows, ["audio_path", "reference", "prediction", "duration_sec"])
    total = predictions.agg(F.count(F.lit(1)).alias("total_predictions"))
    metrics = word_edits.corpus_rates(samples).select(F.lit(model).alias("model"), F.col("evaluated_samples").alias("dataset_size"), "evaluated_samples", *SAMPLE_COLUMNS)
    samples = samples.drop("hits", "char_edits", "chars")
    detailed = with_speaker(samples, metadata, seq) if metadata is not None else samples.withColumn("speaker_id", F.lit(""))
    return metrics.crossJoin(F.broadcast(total)), detailed  # one row each


@dataclass
class GoldScores:
    metrics: DataFrame
    samples: DataFrame
    pairs: DataFrame


def gold_scores(predictions: DataFrame, gold: DataFrame, model: str, test_chapters: list[str], final: bool = False, seq: str = "seq", order: str = "seq") -> GoldScores:
    """Scores against verified references only. Raises NothingScored where no prediction has one.

    order: the column of predictions with their place in the input, for ties of edit pairs.
    """
    rows = with_gold_references(predictions, gold, seq)
    if rows.isEmpty():
        raise NothingScored("no verified references with successful predictions")
    samples = sample_scores(rows, ["segment_id", "audio_path", "reference", "prediction", "duration_sec", "speaker_id"])
    more = {"evaluated_minutes": F.sum("duration_sec") / 60, "speakers": F.array_sort(F.collect_set("speaker_id"))}
    metrics = word_edits.corpus_rates(samples, more=more)
    told = {"model": F.lit(model), "label": F.lit(LABELS[final]), "test_chapters": F.array(*map(F.lit, test_chapters)), "evaluated_minutes": exact_round(F.col("evaluated_minutes"), 2)}
    plain = [text.strip_punctuation(F.coalesce(c, F.lit(""))) for c in ("reference", "prediction")]
    pairs = word_edits.edit_pairs(word_edits.edits_in_order(rows, *plain, F.col(order)))
    return GoldScores(metrics.withColumns(told), samples.drop("hits", "char_edits", "chars"), pairs)


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(only_a, only_b): how many distinct keys stand in one of two tables only."""
    left, right = a.select(F.col(key).alias("a")).distinct(), b.select(F.col(key).alias("b")).distinct()
    both = left.join(right, F.col("a").eqNullSafe(F.col("b")), "full_outer")
    missing = lambda c: F.count_if(F.col(c).isNull())
    return both.agg(missing("b").alias("only_a"), missing("a").alias("only_b"))


def compared(metrics_a: DataFrame, metrics_b: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(metric, a, b, difference_b_minus_a) of two rows of metrics; the difference to six places."""
    long = [m.select(*[F.col(c).cast("double") for c in metrics]).unpivot([], list(metrics), "metric", n) for m, n in ((metrics_a, "a"), (metrics_b, "b"))]
    return long[0].join(long[1], "metric").select("metric", "a", "b", exact_round(F.col("b") - F.col("a"), 6).alias("difference_b_minus_a"))


def comparison(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame], metrics: tuple[str, ...] = METRICS) -> tuple[DataFrame, str]:
    """(differences, label) of two runs (metrics, samples); raises DifferentTestSets. A pilot on either side makes it a pilot."""
    off = set_difference(a[1], b[1], "segment_id").first()
    if off["only_a"] + off["only_b"]:
        raise DifferentTestSets(f"{off['only_a'] + off['only_b']} segment ids differ")
    labels = [m.select("label").first()[0] for m in (a[0], b[0])]
    return compared(a[0], b[0], metrics), "PILOT" if any("PILOT" in x for x in labels) else "FINAL"


def error_analysis(samples: DataFrame) -> DataFrame:
    """(audio_path, reference, prediction, wer, cer, error_summary, manual_category, notes); the last two are for people."""
    told = word_edits.error_summaries(samples, "reference", "prediction", ["audio_path", "reference", "prediction", "cer"])
    return told.select("audio_path", "reference", "prediction", "wer", "cer", "error_summary", F.lit("").alias("manual_category"), F.lit("").alias("notes"))


def in_input_order(pairs: DataFrame) -> DataFrame:
    """Edit pairs with their rank: by count, ties in the order they were first seen in."""
    return numbered(pairs.withColumn("_key", F.struct(-F.col("count"), "first_seq", "first_place")), "_key", "rank").drop("_key")

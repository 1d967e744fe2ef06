"""Markdown reports over a few collected aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import evaluation, manifests, shared, word_edits


def table_text(columns: list[str], rows: list[list]) -> str:
    lines = [columns, ["---"] * len(columns), *rows]
    return "\n".join("| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in line) + " |" for line in lines)


def told(value, places: int = 4) -> str:
    return "n/a" if value is None else f"{value:.{places}f}" if isinstance(value, float) else str(value)


def evaluation_report(name: str, scores: evaluation.GoldScores, day: str, notes: list[str] = (), most: int = 25) -> str:
    """A report of gold scores: metrics, the test set, the most frequent substitutions and the worst samples, `most` of each at most."""
    m = scores.metrics.first()
    pairs = shared.kept(scores.pairs, "edit-pairs")  # read twice
    top = word_edits.top_substitutions(pairs, most).collect()
    sums = word_edits.substitution_totals(pairs).first()
    worst = scores.samples.orderBy(F.desc("wer"), "segment_id").limit(most).collect()
    parts = [f"# {name}: {m['label']}", f"Date: {day}. Model: `{m['model']}`."]
    if m["label"].startswith("PILOT"):
        parts.append("> A pilot: a small test set that checks the way of measuring. It is no final result.")
    parts += [
        "## Metrics",
        table_text(["WER", "CER", "Substitutions", "Deletions", "Insertions", "Reference words"], [[told(m["wer"]), told(m["cer"]), m["substitutions"], m["deletions"], m["insertions"], m["reference_words"]]]),
        "## Test set",
        f"- Segments: {m['evaluated_samples']} ({told(m['evaluated_minutes'], 2)} min)\n- Held-out chapters: {', '.join(m['test_chapters'])}\n- Speakers: {', '.join(m['speakers'])}",
        "## Substitutions",
        f"{sums['similar']} of {sums['all']} substitutions are of similar words (by characters in common; no diagnosis).",
        table_text(["Reference", "Hypothesis", "Count", "Similarity"], [[r["reference_word"], r["hypothesis_word"], r["count"], told(r["similarity"], 2)] for r in top]),
        "## Samples with the highest error rates",
        table_text(["Segment", "WER", "CER"], [[r["segment_id"], told(r["wer"]), told(r["cer"])] for r in worst]),
    ]
    if notes:
        parts += ["## Limits", "\n".join(f"- {n}" for n in notes)]
    return "\n\n".join(parts) + "\n"


def comparison_report(a: str, b: str, differences: DataFrame, label: str, segments: int) -> str:
    rows = [[r["metric"], told(r["a"], 6), told(r["b"], 6), told(r["difference_b_minus_a"], 6)] for r in differences.orderBy("metric").collect()]
    return "\n\n".join([f"# {label} comparison: {a} and {b}", f"The same {segments} segments on both sides. No test of significance was made.", table_text(["Metric", a, b, "B - A"], rows)]) + "\n"


def corpus_report(predictions: DataFrame, metrics: DataFrame) -> str:
    """Files, minutes, outcomes and rates of a batch of predictions."""
    seconds = F.sum(F.col("duration_sec").cast("string").try_cast("double"))
    n = predictions.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "ok").alias("ok"), (F.coalesce(seconds, F.lit(0.0)) / 60).alias("minutes"), F.countDistinct("audio_path").alias("paths")).first()
    m = metrics.first()
    rows = [["Files", n["files"]], ["Distinct paths", n["paths"]], ["Succeeded", n["ok"]], ["Failed", n["files"] - n["ok"]], ["Minutes", told(n["minutes"], 1)], ["Evaluated", m["evaluated_samples"]], ["WER", told(m["wer"])], ["CER", told(m["cer"])]]
    return "# Transcription report\n\n" + table_text(["What", "Value"], rows) + "\n"


def dataset_report(rows: DataFrame) -> str:
    s = manifests.statistics(rows).first()
    parts = manifests.counts_by(rows, "domain", "transcript_status", "split").orderBy("field", "value").collect()
    return "# Dataset\n\n" + table_text(["What", "Value"], [["Utterances", s["utterances"]], ["Minutes", s["minutes"]], ["Known speakers", s["known_speakers"]], *[[f"{p['field']} = {p['value']}", p["n"]] for p in parts]]) + "\n"

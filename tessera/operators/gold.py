"""Segments from import to verified reference: rules, seeding, review, export, queue and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.numbers import exact_round
from tessera.operators import logs
from tessera.operators.numbering import sequence_id

#: The columns, decisions with their status and their other names, the labels of references, the ranks of the review queue.
IDENTITY = ("segment_id", "audio_path", "speaker_id", "source_chapter", "start_sec", "end_sec", "source_ref", "source_url", "align_score", "candidate_text", "raw_asr")
REVIEW = ("decision", "corrected_text", "reviewer", "review_status", "reviewed_at", "provenance", "review_notes")
TRIAGE = ("alignment_score", "agreement_score", "audio_quality_score", "duration_score", "speaking_rate_score", "artifact_score", "confidence_score", "triage_status", "triage_flags", "triage_version")
COLUMNS = IDENTITY + REVIEW + TRIAGE
STATUS_FOR_DECISION = {"correct": "verified", "needs_correction": "verified", "rejected": "rejected", "needs_realignment": "needs_realignment"}
ALIASES = {"VERIFIED": "correct", "CORRECTED": "needs_correction", "REJECTED": "rejected", "NEEDS_REALIGNMENT": "needs_realignment"}
STATUSES = ("pending_review", "verified", "rejected", "needs_realignment")
TRIAGE_STATUSES = ("HIGH_CONFIDENCE_CANDIDATE", "NEEDS_REVIEW", "REJECT_CANDIDATE")
RANKS = {"NEEDS_REVIEW": 0, "": 0, "REJECT_CANDIDATE": 1, "HIGH_CONFIDENCE_CANDIDATE": 2}
GOLD_LABELS, PSEUDO_LABEL = {"correct": "GOLD_VERIFIED", "needs_correction": "GOLD_CORRECTED"}, "PSEUDO_LABELED"
PUBLIC = ("segment_id", "source_chapter", "source_ref", "source_url", "start_sec", "end_sec", "align_score", "candidate_text", "raw_asr", "decision", "corrected_text", "reviewer", "review_status", "reviewed_at", "review_notes", "confidence_score", "alignment_score", "agreement_score", "triage_status", "triage_flags")
LEAST_PLAYED = 0.95


class Rejected(ValueError):
    """A decision, or a table, that breaks the rules; nothing was changed."""


def mapping(pairs: dict[str, str]) -> Column:
    return F.create_map([F.lit(x) for kv in pairs.items() for x in kv])


def set_(column: str) -> Column:
    """Whether a value is there: not null and not empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")) != ""


def blank(column: str) -> Column:
    return text.is_blank(F.col(column))


def with_defaults(rows: DataFrame) -> DataFrame:
    """rows with all columns, empty where they have none, and pending review."""
    out = rows
    for name in COLUMNS:
        if name not in rows.columns:
            out = out.withColumn(name, F.lit("pending_review" if name == "review_status" else ""))
    return out.select(*COLUMNS, *[c for c in rows.columns if c not in COLUMNS])


def is_gold() -> Column:
    return (F.col("review_status") == "verified") & F.col("decision").isin(*GOLD_LABELS)


def is_pseudo_eligible() -> Column:
    return (F.col("review_status") == "pending_review") & (F.col("triage_status") == "HIGH_CONFIDENCE_CANDIDATE") & ~blank("candidate_text")


def reference() -> Column:
    """The verified text: the corrected one where a correction was needed."""
    return F.when(F.col("decision") == "needs_correction", F.col("corrected_text")).otherwise(F.col("candidate_text"))


def rules() -> list[tuple[str, Column]]:
    """(rule, whether a row breaks it), in the order of the messages."""
    decision = F.coalesce(F.col("decision"), F.lit(""))
    status = F.coalesce(F.col("review_status"), F.lit(""))
    start, end = F.col("start_sec").cast("string").try_cast("double"), F.col("end_sec").cast("string").try_cast("double")
    decided = decision != ""
    return [
        ("unknown_status", ~status.isin(*STATUSES)),
        ("decision_does_not_match", decided & ~F.coalesce(mapping(STATUS_FOR_DECISION)[decision] == status, F.lit(False))),
        ("review_incomplete", (status != "pending_review") & ~(decided & ~blank("reviewer"))),
        ("correction_missing", (decision == "needs_correction") & blank("corrected_text")),
        ("candidate_missing", (decision == "correct") & blank("candidate_text")),
        ("one_bound_only", set_("start_sec") != set_("end_sec")),
        ("end_not_after_start", set_("start_sec") & set_("end_sec") & ~F.coalesce(end > start, F.lit(False))),
    ]


def violations(rows: DataFrame, seq: str) -> DataFrame:
    """(segment_id, seq, error), one row for each broken rule; every occurrence of an id after the first (by seq) is a duplicate.

    Only ids that stand more than once meet the window: they are counted first, with map-side combining.
    """
    found = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules()]))
    own = rows.select("segment_id", seq, F.explode(found).alias("error"))
    first = rows.groupBy("segment_id").agg(F.count(F.lit(1)).alias("_n"), F.min(seq).alias("_first")).filter("_n > 1")
    again = rows.select("segment_id", seq).join(first, "segment_id").filter(F.col(seq) > F.col("_first"))
    return again.select("segment_id", seq, F.lit("duplicate_segment_id").alias("error")).unionByName(own)


def checked(rows: DataFrame, seq: str) -> DataFrame:
    """rows, if no rule is broken; else Rejected, with the first errors."""
    errors = violations(rows, seq).limit(20).collect()
    if errors:
        raise Rejected("; ".join(f"{e['segment_id']}: {e['error']}" for e in errors))
    return rows


def seeded(rows: DataFrame, chunks: DataFrame, model: str, folder: str = "audio") -> DataFrame:
    """rows and a pending segment for each chunk(stem, chunk_index, start_sec, end_sec, prediction, status, seq) whose last try went well.

    No candidate text: a person types what they hear. Segments that are there stay as they are.
    """
    last = logs.latest_wins(chunks, ["stem", "chunk_index"], F.col("seq"), F.col("status") == "ok")
    new = last.select(
        sequence_id(F.col("stem"), F.col("chunk_index"), mark="_c").alias("segment_id"),
        F.concat(F.lit(f"{folder}/"), "stem", F.lit(".mp3")).alias("audio_path"),
        F.lit("unknown").alias("speaker_id"),
        F.col("stem").alias("source_chapter"),
        "start_sec",
        "end_sec",
        text.stripped(F.coalesce("prediction", F.lit(""))).alias("raw_asr"),
        F.lit(f"asr_chunk_raw:{model}").alias("provenance"),
    )
    return added(rows, new)


def added(rows: DataFrame, new: DataFrame) -> DataFrame:
    """rows, then new's with the types and columns of rows, where rows lacks their id."""
    full = with_defaults(new)
    typed = full.select(*[F.col(c).try_cast(rows.schema[c].dataType).alias(c) if c in rows.columns else F.col(c) for c in full.columns])
    return logs.appended(rows, typed.select(*[c for c in rows.columns if c in typed.columns]), "segment_id")


def imported(rows: DataFrame, alignments: DataFrame, chapters: DataFrame, model: str) -> DataFrame:
    """rows and a pending segment for each alignment(stem, segment_id, audio_path, start_sec, end_sec, text, raw_asr, units, align_score), the published text as candidate.

    chapters(stem, url). An alignment whose chapter isn't there is an error: Rejected.
    """
    lost = logs.to_do(alignments.select("stem").distinct(), chapters, "stem").limit(5).collect()
    if lost:
        raise Rejected("no chapter text for " + ", ".join(str(r[0]) for r in lost))
    new = alignments.join(chapters.select("stem", F.col("url").alias("source_url")), "stem").select(
        "segment_id",
        "audio_path",
        F.lit("unknown").alias("speaker_id"),
        F.col("stem").alias("source_chapter"),
        "start_sec",
        "end_sec",
        F.col("units").alias("source_ref"),
        "source_url",
        "align_score",
        F.col("text").alias("candidate_text"),
        "raw_asr",
        F.lit(f"text_align:{model}:ctc_viterbi").alias("provenance"),
    )
    return added(rows, new)


def reviewed(rows: DataFrame, decisions: DataFrame, seq: str) -> DataFrame:
    """rows with decisions(segment_id, decision, reviewer, corrected_text, notes, reviewed_at, seq) recorded, the last of a segment; candidate texts stay.

    The first row of an id takes the decision. Unknown decisions, reviewers that are no pseudonym, unknown ids and rows that would break a rule
    raise Rejected, and nothing is changed.
    """
    last = logs.latest_wins(decisions, "segment_id", F.col("seq")).drop("seq")
    plain = F.coalesce(mapping(ALIASES)[F.col("decision")], F.col("decision"))
    last = last.select("segment_id", plain.alias("_decision"), text.stripped(F.coalesce("reviewer", F.lit(""))).alias("_reviewer"), text.stripped(F.coalesce("corrected_text", F.lit(""))).alias("_text"), text.collapsed(F.coalesce("notes", F.lit(""))).alias("_notes"), F.col("reviewed_at").alias("_at"))
    bad = last.filter(~F.coalesce(F.col("_decision").isin(*STATUS_FOR_DECISION), F.lit(False)) | ~text.is_reviewer(F.col("_reviewer"))).limit(1).collect()
    if bad:
        raise Rejected(f"{bad[0]['segment_id']}: not a decision of a reviewer")
    unknown = logs.to_do(last, rows, "segment_id").limit(1).collect()
    if unknown:
        raise Rejected(f"unknown segment {unknown[0]['segment_id']}")
    first = rows.groupBy("segment_id").agg(F.min(seq).alias("_first"))
    joined = rows.join(last.join(first, "segment_id"), "segment_id", "left")
    mine = F.col("_decision").isNotNull() & (F.col(seq) == F.col("_first"))
    values = {
        "decision": F.col("_decision"),
        "corrected_text": F.when(F.col("_decision") == "needs_correction", F.col("_text")).otherwise(""),
        "reviewer": F.col("_reviewer"),
        "review_status": mapping(STATUS_FOR_DECISION)[F.col("_decision")],
        "reviewed_at": F.col("_at"),
        "review_notes": F.col("_notes"),
    }
    made = joined.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in values.items()})
    wrong = made.filter(mine).select("segment_id", F.explode(F.array_compact(F.array(*[F.when(b, F.lit(n)) for n, b in rules()]))).alias("error")).limit(1).collect()
    if wrong:
        raise Rejected(f"{wrong[0]['segment_id']}: {wrong[0]['error']}")
    return made.select(*rows.columns)


def accepted(posted: DataFrame) -> DataFrame:
    """posted decisions with `error`: verifying ones need played_fraction of LEAST_PLAYED; null where there is none."""
    verifying = F.col("decision").isin("correct", "needs_correction", "VERIFIED", "CORRECTED")
    heard = F.coalesce(F.col("played_fraction"), F.lit(0.0)) >= LEAST_PLAYED
    return posted.withColumn("error", F.when(verifying & ~heard, "listen to the whole clip before verifying it"))


def exported(rows: DataFrame, chapters: list[str] | None = None, folder: str = "evaluation/audio") -> DataFrame:
    """The evaluation set: verified rows, of some chapters or all, with their references and the paths of their clips."""
    kept = rows.filter("review_status = 'verified'")
    kept = kept if chapters is None else kept.filter(F.col("source_chapter").isin(*chapters))
    start = F.coalesce(F.col("start_sec").cast("string").try_cast("double"), F.lit(0.0))
    length = F.col("end_sec").cast("string").try_cast("double") - start
    return kept.select(F.concat(F.lit(f"{folder}/"), "segment_id", F.lit(".wav")).alias("audio_path"), reference().alias("reference_text"), "speaker_id", "segment_id", "source_chapter", length.alias("duration_sec"))


def queue_order() -> list[Column]:
    """Rank of the triage status (0 where it is unknown), confidence (0 where it is no number), id."""
    rank = F.coalesce(F.create_map([F.lit(x) for kv in RANKS.items() for x in kv])[F.coalesce("triage_status", F.lit(""))], F.lit(0))
    return [rank, F.coalesce(text.number(F.col("confidence_score").cast("string")), F.lit(0.0)), F.col("segment_id")]


def queue(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Rows for review in their order, with the public columns; most: only the first."""
    ordered = rows.orderBy(*queue_order())
    return (ordered if most is None else ordered.limit(most)).select(*[c for c in PUBLIC if c in rows.columns])


def progress(rows: DataFrame) -> DataFrame:
    """How far the review is, in one row; one pass."""
    end, start = (F.col(c).cast("string").try_cast("double") for c in ("end_sec", "start_sec"))
    done = F.count_if(F.coalesce(F.col("review_status"), F.lit("")) != "pending_review")
    seconds = F.sum(F.when((F.col("review_status") == "verified") & set_("end_sec"), end - start))
    told = {"verified": "correct", "corrected": "needs_correction", "rejected": "rejected", "needs_realignment": "needs_realignment"}
    counts = [F.count_if(F.col("decision") == v).alias(k) for k, v in told.items()]
    triage = [F.count_if(F.col("triage_status") == s).alias(s.lower()) for s in TRIAGE_STATUSES]
    out = rows.agg(F.count(F.lit(1)).alias("total"), done.alias("reviewed"), *counts, (F.coalesce(seconds, F.lit(0.0)) / 60).alias("verified_minutes"), *triage)
    return out.withColumns({"remaining": F.col("total") - F.col("reviewed"), "verified_minutes": exact_round(F.col("verified_minutes"), 2)})


def routed(rows: DataFrame, test: list[str], validation: list[str], unverified: bool = False) -> DataFrame:
    """rows with split: test holds gold rows only; others that aren't gold are left out, or, if unverified, pseudo-labelled where eligible. Rows without a start go."""
    chapter = F.col("source_chapter")
    in_test = F.coalesce(chapter.isin(*test), F.lit(False)) if test else F.lit(False)
    side = F.when(F.coalesce(chapter.isin(*validation), F.lit(False)), "val").otherwise("train") if validation else F.lit("train")
    split = F.when(in_test, F.when(is_gold(), "test")).when(is_gold(), side)
    if unverified:
        split = split.when(is_pseudo_eligible(), F.concat(side, F.lit("_pseudo_labeled")))
    return rows.filter(set_("start_sec")).withColumn("split", split).filter("split is not null")


def leaked_chapters(routed_rows: DataFrame, test: list[str], validation: list[str]) -> DataFrame:
    """Held-out chapters among the rows for training; empty if all is well."""
    held = F.array_union(F.array(*map(F.lit, test)).cast("array<string>"), F.array(*map(F.lit, validation)).cast("array<string>"))
    return routed_rows.filter(F.col("split").startswith("train") & F.array_contains(held, F.col("source_chapter"))).select("source_chapter").distinct()


def manifest_lines(rows: DataFrame, folder: str = "audio", language: str = "mr") -> DataFrame:
    """Lines of training manifests: audio_filepath, offset, duration, text, lang, segment_id, label_source, and split if it is there."""
    start, end = F.col("start_sec").cast("string").try_cast("double"), F.col("end_sec").cast("string").try_cast("double")
    said = F.when(is_gold(), reference()).otherwise(F.col("candidate_text"))
    label = F.when(is_gold(), mapping(GOLD_LABELS)[F.col("decision")]).otherwise(PSEUDO_LABEL)
    more = [c for c in ("split", "source_chapter") if c in rows.columns]
    return rows.select(
        F.concat(F.lit(f"{folder}/"), "source_chapter", F.lit(".wav")).alias("audio_filepath"),
        exact_round(start, 3).alias("offset"),
        exact_round(end - start, 3).alias("duration"),
        text.strip_punctuation(said).alias("text"),
        F.lit(language).alias("lang"),
        "segment_id",
        label.alias("label_source"),
        *more,
    )


def manifest_summary(lines: DataFrame) -> DataFrame:
    """(split, segments, hours, chapters)."""
    found = lines.groupBy("split").agg(F.count(F.lit(1)).alias("segments"), (F.sum(F.col("duration").cast("decimal(18,3)")).cast("double") / 3600).alias("hours"), F.countDistinct("source_chapter").alias("chapters"))
    return found.withColumn("hours", exact_round(F.col("hours"), 3))


def label_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("split", "label_source").agg(F.count(F.lit(1)).alias("n"))


def shortest(lines: DataFrame, most: int) -> DataFrame:
    """The shortest lines, for a quick trial run; ties by segment_id."""
    return lines.orderBy("duration", "segment_id").limit(most)


def bundle_check(lines: DataFrame, files: DataFrame, language: str = "mr") -> DataFrame:
    """(split, segments, wrong_language, missing_audio, hours) of manifest lines against files(path)."""
    there = lines.join(files.select(F.col("path").alias("audio_filepath"), F.lit(True).alias("_there")).distinct(), "audio_filepath", "left")
    hours = F.sum(F.col("duration").cast("decimal(18,3)")).cast("double") / 3600
    lost = F.countDistinct(F.when(F.col("_there").isNull(), F.col("audio_filepath")))
    return there.groupBy("split").agg(F.count(F.lit(1)).alias("segments"), F.count_if(~F.col("lang").eqNullSafe(F.lit(language))).alias("wrong_language"), lost.alias("missing_audio"), hours.alias("hours"))


def chapter_ids(rows: DataFrame, chapter: str, order: str) -> DataFrame:
    """rows with segment_id `<chapter>_a000` and so on, in their order."""
    place = F.row_number().over(Window.partitionBy(chapter).orderBy(order)) - 1
    return rows.withColumn("segment_id", sequence_id(F.col(chapter), place, mark="_a"))

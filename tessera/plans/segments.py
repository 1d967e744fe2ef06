"""Queries of segments in review, manifests, splits, speakers and triage, with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.numbers import exact_round
from tessera.operators import gold, logs, manifests, speakers, splits, summaries, triage
from tessera.operators.numbering import numbered
from tessera.plans import surrogates as s
from tessera.plans.scoring import scored_sql, six

SALT = "pepper"


def gold_references(spark, d):
    return s.gold(spark, d).filter(gold.is_gold()).select("segment_id", F.md5(gold.reference()).alias("reference_md5"))


def pseudo_eligible(spark, d):
    return s.gold(spark, d).filter(gold.is_pseudo_eligible()).select("segment_id")


def gold_violations(spark, d):
    rows = s.gold(spark, d)
    again = rows.filter("seq % 37 = 0").withColumn("seq", F.col("seq") + 10_000_000)
    return gold.violations(rows.unionByName(again), "seq")


def seeded_segments(spark, d):
    chunks = s.chunk_log(spark, d).withColumns({"start_sec": F.col("chunk_index") * 20.0, "end_sec": F.col("chunk_index") * 20.0 + 20})
    there = gold.with_defaults(s.chunk_log(spark, d).filter("seq % 3 = 0").select(F.concat("stem", F.format_string("_c%03d", "chunk_index")).alias("segment_id")).distinct())
    typed = there.withColumns({"start_sec": F.lit(None).cast("double"), "end_sec": F.lit(None).cast("double")})
    return gold.seeded(typed, chunks, "m").select("segment_id", "source_chapter", "start_sec", "end_sec", "raw_asr", "provenance")


def imported_segments(spark, d):
    rows = gold.with_defaults(s.gold(spark, d).filter("seq % 2 = 0").drop("seq", "n_headings"))
    new = s.gold(spark, d).select(F.col("source_chapter").alias("stem"), "segment_id", "audio_path", "start_sec", "end_sec", F.col("candidate_text").alias("text"), "raw_asr", F.lit("u").alias("units"), "align_score")
    chapters = s.table(spark, d, "documents").select(F.col("source").alias("stem")).distinct().withColumn("url", F.concat(F.lit("http://x/"), "stem"))
    return gold.imported(rows, new, chapters, "m").select("segment_id", "source_chapter", "source_url", "review_status", "provenance")


def reviewed_segments(spark, d):
    rows = s.gold(spark, d).withColumns({"reviewed_at": F.lit(""), "review_notes": F.lit("")})
    said = rows.filter("review_status = 'pending_review' and start_sec is not null and end_sec > 0 and candidate_text <> ''")
    first = said.select("segment_id", F.lit("REJECTED").alias("decision"), F.lit("ab").alias("reviewer"), F.lit("").alias("corrected_text"), F.lit(" a  b ").alias("notes"), F.lit("t").alias("reviewed_at"), "seq")
    again = said.filter("seq % 2 = 0").select("segment_id", F.lit("CORRECTED").alias("decision"), F.lit(" cd").alias("reviewer"), F.lit(" new ").alias("corrected_text"), F.lit("").alias("notes"), F.lit("t").alias("reviewed_at"), (F.col("seq") + 10_000_000).alias("seq"))
    return gold.reviewed(rows, first.unionByName(again), "seq").select("segment_id", "decision", "reviewer", "review_status", "review_notes", F.md5("corrected_text").alias("corrected_md5"))


def accepted_decisions(spark, d):
    posted = s.gold(spark, d).select("segment_id", "decision", (F.col("seq") % 100 / 100.0).alias("played_fraction"))
    return gold.accepted(posted).groupBy("decision", "error").agg(F.count(F.lit(1)).alias("n"))


def evaluation_export(spark, d):
    return gold.exported(s.gold(spark, d), ["src0", "src1", "src2", "src3", "src4"]).select("audio_path", F.md5("reference_text").alias("reference_md5"), "segment_id", "source_chapter", "duration_sec")


def review_queue(spark, d):
    return gold.queue(s.gold(spark, d), 50).select("segment_id", "triage_status", "confidence_score")


def review_progress(spark, d):
    return gold.progress(s.gold(spark, d))


TEST, VALIDATION = ["src0", "src1"], ["src2"]


def manifest_lines(spark, d):
    routed = gold.routed(s.gold(spark, d), TEST, VALIDATION, unverified=True)
    return gold.manifest_lines(routed).select("split", "audio_filepath", "offset", "duration", F.md5("text").alias("text_md5"), "lang", "segment_id", "label_source")


def manifest_line_summary(spark, d):
    return gold.manifest_summary(gold.manifest_lines(gold.routed(s.gold(spark, d), TEST, VALIDATION, unverified=True)))


def manifest_label_counts(spark, d):
    return gold.label_counts(gold.manifest_lines(gold.routed(s.gold(spark, d), TEST, VALIDATION, unverified=True)))


def held_out_leaks(spark, d):
    rows = s.gold(spark, d).withColumn("split", F.when(F.col("seq") % 11 == 0, "train").otherwise("val"))
    return gold.leaked_chapters(rows, TEST, VALIDATION)


def shortest_lines(spark, d):
    lines = gold.manifest_lines(gold.routed(s.gold(spark, d), TEST, VALIDATION, unverified=True))
    return gold.shortest(lines.filter("duration is not null"), 16).select("segment_id", "duration")


def bundle_check(spark, d):
    lines = gold.manifest_lines(gold.routed(s.gold(spark, d), TEST, VALIDATION))
    files = s.table(spark, d, "documents").filter("source <> 'src3'").select(F.concat(F.lit("audio/"), "source", F.lit(".wav")).alias("path")).distinct()
    return gold.bundle_check(lines.withColumn("lang", F.when(F.col("label_source") == "GOLD_CORRECTED", "en").otherwise(F.col("lang"))), files).withColumn("hours", exact_round(F.col("hours"), 6))


def chapter_segment_ids(spark, d):
    return gold.chapter_ids(s.table(spark, d, "conversations").select(F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("chapter"), "turn"), "chapter", "turn")


def manifest_violations(spark, d):
    return manifests.violations(s.manifest(spark, d))


def manifest_upsert(spark, d):
    rows = s.manifest(spark, d).withColumn("seq", F.substring("utterance_id", 2, 20).cast("long"))
    old = rows.filter("seq % 3 <> 2")
    new = rows.filter("seq % 2 = 0").withColumns({"transcript": F.lit("new"), "split": F.lit("unassigned")})
    return logs.upsert(old, new, "utterance_id", "split", "seq").select("utterance_id", "transcript", "split", "seq")


def audio_manifest(spark, d):
    files = s.table(spark, d, "orders").select(F.concat(F.lit("file:/a/b/X_"), F.col("o_orderkey").cast("string"), F.lit(".mp3")).alias("path"), (F.col("o_totalprice") / 1024).alias("duration_sec"))
    return manifests.listed(files, "P_", "s", "l", "d").select("utterance_id", "audio_path", "speaker_id", "duration_sec", "transcript_status", "split")


def customer_splits(spark, d):
    return splits.speaker_map(s.manifest(spark, d), "speaker_id", "duration_sec")


def manifest_splits(spark, d):
    rows = splits.assigned(s.manifest(spark, d), "speaker_id", "duration_sec")
    return manifests.split_summary(rows)


def customer_leaks(spark, d):
    return manifests.leaks(s.manifest(spark, d).withColumn("split", F.when(F.col("utterance_id").substr(-1, 1) < "4", "train").when(F.col("utterance_id").substr(-1, 1) < "7", "test").otherwise("unassigned")))


def dataset_statistics(spark, d):
    return manifests.statistics(s.manifest(spark, d))


def dataset_counts(spark, d):
    return manifests.counts_by(s.manifest(spark, d), "domain", "transcript_status", "split")


def dataset_problems(spark, d):
    return manifests.problems(s.manifest(spark, d), gold.violations(s.gold(spark, d), "seq")).groupBy("kind", "error").agg(F.count(F.lit(1)).alias("n"))


def dataset_counters(spark, d):
    rows = s.predictions(spark, d).select((F.col("status") == "ok").alias("valid"), F.when(F.col("seq") % 4 > 0, F.col("reference")).alias("reference_text"), "duration_sec")
    return manifests.dataset_counters(rows)


def sorted_manifest(spark, d):
    return numbered(s.manifest(spark, d).select("utterance_id", "speaker_id"), "utterance_id", "place")


def pseudonyms(spark, d):
    people = s.table(spark, d, "customer").select(F.concat(F.lit(" "), "c_name").alias("speaker_key"), F.col("c_custkey").alias("seq"))
    twice = people.unionByName(people.select(F.upper("speaker_key").alias("speaker_key"), (F.col("seq") + 1_000_000).alias("seq")))
    old = s.table(spark, d, "customer").filter("c_custkey % 10 < 2")
    registry = old.select(F.concat(F.lit("VH_S"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("speaker_id"), speakers.key_hash(F.col("c_name"), SALT).alias("key_hash"), F.when(F.col("c_custkey") % 10 == 0, "active").otherwise("withdrawn").alias("status"), F.lit(date(2020, 1, 1)).alias("registered_on"))
    found, _ = speakers.identified(twice, registry, SALT, "seq", date(2020, 1, 2))
    return found.select("seq", "speaker_id")


def key_hashes(spark, d):
    return s.table(spark, d, "customer").select("c_custkey", speakers.key_hash(F.concat(F.lit("  "), "c_name", F.lit(" ")), SALT).alias("key_hash"))


def gated_recordings(spark, d):
    rows = s.manifest(spark, d).select("utterance_id", F.when(F.col("consent_status") == "given", "given").otherwise("no").alias("consent"), (F.col("duration_sec") * 3).cast("double").alias("duration_sec"), (F.col("domain") != "low").alias("valid"), F.lit("zero-length audio").alias("reason"))
    return speakers.gated(rows).groupBy(F.regexp_replace("rejected", "[0-9.]+s", "N").alias("rejected")).agg(F.count(F.lit(1)).alias("n"))


def registered_recordings(spark, d):
    old = s.manifest(spark, d).select("speaker_id", F.concat("speaker_id", F.lit("_"), F.lpad(F.substring("utterance_id", -3, 3), 4, "0")).alias("utterance_id"))
    new = s.signals(spark, d).select(F.concat(F.lit("VH_S"), F.lpad((F.col("vec_id") % 50 + 1).cast("string"), 6, "0")).alias("speaker_id"), F.lit("x").alias("district"), F.lit("general").alias("domain"), F.lit("").alias("age_group"), F.lit("").alias("gender"), F.when(F.col("vec_id") % 2 == 0, "read this").alias("prompt_text"), F.lit(1.0).alias("duration_sec"), "samples", F.col("vec_id").alias("seq"))
    return speakers.registered(new, old, "seq", "d").select("utterance_id", "audio_path", "transcript_status", "recording_quality")


def withdrawal(spark, d):
    tables = {"manifest": s.manifest(spark, d).select("utterance_id", "speaker_id")}
    registry = s.manifest(spark, d).select("speaker_id").distinct().select("speaker_id", F.md5("speaker_id").alias("key_hash"), F.lit("active").alias("status"), F.lit(date(2020, 1, 1)).alias("registered_on"))
    left, gone = speakers.withdrawn(tables, registry, "VH_S000001")
    kept = left["manifest"].agg(F.count(F.lit(1)).alias("n"))
    return gone.groupBy("status").agg(F.count(F.lit(1)).alias("speakers"), F.count_if(F.col("key_hash") == "").alias("blank")).crossJoin(F.broadcast(kept))


def triage_scores(spark, d):
    return found_triage(spark, d).select("segment_id", "duration_sec", "chars_per_sec", "cer_vs_asr", "insert_delete_rate", "alignment_score", "agreement_score", "audio_quality_score", "duration_score", "speaking_rate_score", "artifact_penalty", "base_confidence", "confidence_score", "triage_flags", "triage_status")


def found_triage(spark, d):
    """Triage of the segments from raw inputs, with the signal of the vector that has the document's number."""
    from tessera.functions import signals

    sound = s.signals(spark, d).select(F.format_string("s%08d", "vec_id").alias("segment_id"), signals.audio_signals(F.col("samples"), signals.frame_of(F.col("rate"))).alias("audio"))
    rows = s.gold(spark, d).drop("triage_status", "confidence_score")
    joined = rows.drop("n_headings").join(sound, "segment_id", "left").withColumn("align_score", F.when(F.col("seq") % 41 != 0, F.col("align_score")))
    return triage.told(triage.scored(joined, rows.select("segment_id", "n_headings")))


def triage_status_counts(spark, d):
    return triage.status_counts(found_triage(spark, d))


def triage_by_chapter(spark, d):
    return triage.by_chapter(found_triage(spark, d), "source_chapter")


def triage_flag_counts(spark, d):
    return triage.flag_counts(found_triage(spark, d))


def triage_review_counts(spark, d):
    return triage.review_counts(s.gold(spark, d))


def triage_distributions(spark, d):
    return triage.distributions(found_triage(spark, d))


def triage_updates(spark, d):
    rows = s.gold(spark, d).withColumns({"triage_version": F.lit(""), "triage_flags": F.lit("")})
    found = found_triage(spark, d).filter("source_chapter = 'src0'")
    return triage.updated(rows, found).groupBy("triage_version", "triage_status").agg(F.count(F.lit(1)).alias("n"))


def flags_of_turns(spark, d):
    rows = s.turn_pairs(spark, d)
    flags = text.artifact_flags(F.col("candidate"), F.col("asr"), F.col("turn") % 3)
    return rows.select("conv_id", "turn", F.array_join(flags, ";").alias("flags"))


def flag_counts(spark, d):
    return triage.flag_counts(flags_of_turns(spark, d).withColumnRenamed("flags", "triage_flags"))


def text_signals_of_turns(spark, d):
    found = triage.text_signals(s.turn_pairs(spark, d).filter("role <> 'system'"), "candidate", "asr", ["conv_id", "turn"])
    return found.groupBy(F.col("insert_delete_rate") > 0.9).agg(F.count(F.lit(1)).alias("n"), F.sum("substitutions").alias("substitutions")).select("n", "substitutions")


def speaking_rates(spark, d):
    rows = s.pairs(spark, d)
    return rows.select("doc_id", exact_round(text.speaking_rate(F.col("reference"), F.when(F.col("doc_id") % 9 > 0, F.col("n_chars") / 9.0).otherwise(0.0)), 4).alias("rate"))


def event_value_quantiles(spark, d):
    return summaries.quantile_summary(s.table(spark, d, "events"), "event_type", "value")


def event_type_counts(spark, d):
    return summaries.closed_counts(s.table(spark, d, "events"), "event_type", ["click", "view", "purchase", "error", "never"])


def status_by_priority(spark, d):
    return s.table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


QUERIES = {
    f.__name__: f
    for f in (
        gold_references, pseudo_eligible, gold_violations, seeded_segments, imported_segments, reviewed_segments, accepted_decisions, evaluation_export, review_queue, review_progress,
        manifest_lines, manifest_line_summary, manifest_label_counts, held_out_leaks, shortest_lines, bundle_check, chapter_segment_ids, manifest_violations, manifest_upsert, audio_manifest, customer_splits,
        manifest_splits, customer_leaks, dataset_statistics, dataset_counts, dataset_problems, dataset_counters, sorted_manifest, pseudonyms, key_hashes, gated_recordings, registered_recordings, withdrawal,
        triage_scores, triage_status_counts, triage_by_chapter, triage_flag_counts, triage_review_counts, triage_distributions, triage_updates, flags_of_turns, flag_counts, text_signals_of_turns, speaking_rates,
        event_value_quantiles, event_type_counts, status_by_priority,
    )
}

IS_GOLD = "(review_status = 'verified' and decision in ('correct', 'needs_correction'))"
REFERENCE = "case when decision = 'needs_correction' then corrected_text else candidate_text end"
ELIGIBLE = "(review_status = 'pending_review' and triage_status = 'HIGH_CONFIDENCE_CANDIDATE' and trim(candidate_text) <> '')"
STATUS = "case decision when 'correct' then 'verified' when 'needs_correction' then 'verified' else decision end"


def errors_sql(rows: str) -> str:
    return f"""select segment_id, seq, unnest(list_filter([case when decision <> '' and {STATUS} <> review_status then 'decision_does_not_match' end, case when review_status <> 'pending_review' and (decision = '' or reviewer = '') then 'review_incomplete' end,
 case when decision = 'needs_correction' and trim(corrected_text) = '' then 'correction_missing' end, case when decision = 'correct' and trim(candidate_text) = '' then 'candidate_missing' end,
 case when (start_sec is null) <> (end_sec is null) then 'one_bound_only' end, case when start_sec is not null and end_sec is not null and end_sec <= start_sec then 'end_not_after_start' end], lambda e: e is not null)) as error from {rows}"""


ROUTED = f"""routed as (select *, case when source_chapter in ('src0', 'src1') then case when {IS_GOLD} then 'test' end when {IS_GOLD} then case when source_chapter = 'src2' then 'val' else 'train' end
 when unverified and {ELIGIBLE} then case when source_chapter = 'src2' then 'val' else 'train' end || '_pseudo_labeled' end as split from gold cross join (select UNVERIFIED as unverified) where start_sec is not null),
 lines as (select split, 'audio/' || source_chapter || '.wav' as audio_filepath, cast(format('{{:.3f}}', start_sec) as double) as "offset", cast(format('{{:.3f}}', end_sec - start_sec) as double) as duration, md5({s.stripped_sql(f"case when {IS_GOLD} then {REFERENCE} else candidate_text end")}) as text_md5, 'mr' as lang, segment_id,
 case when {IS_GOLD} then case decision when 'correct' then 'GOLD_VERIFIED' else 'GOLD_CORRECTED' end else 'PSEUDO_LABELED' end as label_source, source_chapter from routed where split is not null)"""
LINES = f"with {s.GOLD}, {ROUTED.replace('UNVERIFIED', 'true')}"
RULES = f"""select utterance_id, unnest(list_filter([case when domain not in ('general', 'scripture', 'agriculture') then 'domain_not_allowed' end, case when not regexp_full_match(speaker_id, 'VH_S[0-9]{{3,}}|unknown') then 'speaker_id_malformed' end,
 case when transcript_status = 'not_available' and trim(transcript) <> '' then 'transcript_without_status' end, case when transcript_status = 'verified' and trim(transcript) = '' then 'verified_without_transcript' end,
 case when source = 'native_recording' and consent_status <> 'given' then 'native_without_consent' end], lambda e: e is not null)) as error from manifest"""
SPLIT = """e as (select speaker_id, sum(case when duration_sec = 0 then 1 else duration_sec end) as own from manifest where speaker_id <> 'unknown' group by 1), r as (select *, sum(own) over (order by md5('13' || speaker_id) rows unbounded preceding) as upto, sum(own) over () as total from e),
 t as (select *, upto - own < total * 0.1 as in_test from r), m as (select coalesce(max(upto), 0) as test_end from t where in_test), splits as (select speaker_id, case when in_test then 'test' when upto - own - test_end < total * 0.1 then 'validation' else 'train' end as split from t, m)"""
BLOCK = 64


def hmac_sql(message: str, key: bytes) -> str:
    pad = lambda x: "unhex('" + bytes(b ^ x for b in key.ljust(BLOCK, b"\0")).hex() + "')"
    return f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode({message}))))"


HASHED = hmac_sql("lower(trim(c_name))", SALT.encode())


def ramp_sql(x: str, bad: float, good: float) -> str:
    return f"case when {x} is null then 0.0 else greatest(0.0::double, least(1.0::double, ({x} - ({bad})::double) / ({good}::double - ({bad})::double))) end"


def plateau_sql(x: str, limits: tuple[float, float, float, float]) -> str:
    a, b, c, e = limits
    return f"case when {x} < {b} then {ramp_sql(x, a, b)} when {x} > {c} then {ramp_sql(x, e, c)} else 1.0 end"


def four(x: str) -> str:
    return f"cast(format('{{:.4f}}', {x}) as double)"


def flags_sql(candidate: str, asr: str, words: str, n: str) -> str:
    return rf"""case when trim({candidate}) = '' then 'empty_candidate' end, case when trim({asr}) = '' then 'empty_asr' end, case when regexp_matches({candidate}, '[()\[\]{{}}]') then 'parentheses' end, case when regexp_matches({candidate}, '[0-9A-Za-z]') then 'digits_or_latin' end,
 case when len(list_filter(range(1, greatest(len({words}) - 1, 1)), lambda i: {words}[i] = {words}[i + 1] and {words}[i] = {words}[i + 2])) > 0 then 'repeated_word' end, case when {n} > 0 then 'contains_heading' end"""


def frames_sql(samples: str) -> str:
    return f"list_transform(range(0, len({samples}) // {s.FRAME}), lambda i: {samples}[i * {s.FRAME} + 1 : i * {s.FRAME} + {s.FRAME}])"


def square_sql(samples: str) -> str:
    return f"list_sum(list_transform({samples}, lambda x: x::double * x::double)) / len({samples})"


AUDIO = f"""sound as (select vec_id, len(list_filter(list_transform({frames_sql('samples')}, lambda f: 20 * log10(greatest(sqrt({square_sql('f')}), 1e-12))), lambda v: v < -40)) / (len(samples) // {s.FRAME}) as silence, len(list_filter(samples, lambda x: abs(x) >= 0.999::float)) / len(samples) as clip, 20 * log10(greatest(sqrt({square_sql('samples')}), 1e-12)) as rms from signals)"""
T = {"align_score": (-2.0, -0.5), "cer": (0.45, 0.12), "moved": (0.35, 0.05), "silence": (0.7, 0.3), "clip": (0.01, 0.0005), "low": (-40.0, -30.0), "high": (-1.0, -6.0)}
TRIAGE = f"""with {s.GOLD}, {s.SIGNALS}, {AUDIO}, joined as (select g.* exclude (align_score, triage_status), case when g.seq % 41 <> 0 then g.align_score end as align_score, a.silence, a.clip, a.rms, candidate_text as reference, raw_asr as prediction from gold g left join sound a on g.segment_id = printf('s%08d', a.vec_id)),
 {scored_sql('joined')}, texts as (select *, r = '' or h = '' as none, coalesce(end_sec - start_sec, 0.0) as duration from scored),
 rated as (select *, case when none then 1.0 else char_edits / chars end as cer, case when none then 1.0 else (insertions + deletions) / greatest(reference_words, 1) end as moved, case when duration > 0 then length(replace(r, ' ', '')) / duration else 0.0 end as rate from texts),
 parts as (select *, {ramp_sql('align_score', *T['align_score'])} as p1, ({ramp_sql('cer', *T['cer'])} + {ramp_sql('moved', *T['moved'])}) / 2 as p2,
 case when silence is null then 0.0 else ({ramp_sql('silence', *T['silence'])} + {ramp_sql('clip', *T['clip'])} + least({ramp_sql('rms', *T['low'])}, {ramp_sql('rms', *T['high'])})) / 3 end as p3, {plateau_sql('duration', (1.0, 3.0, 25.0, 45.0))} as p4, {plateau_sql('rate', (4.5, 6.5, 12.5, 16.0))} as p5 from rated),
 flagged as (select *, list_filter([{flags_sql('candidate_text', 'raw_asr', 'rw', 'n_headings')}, case when align_score is null then 'missing_align_score' end, case when silence is null then 'audio_unavailable' end, case when p4 = 0 then 'duration_out_of_range' end, case when p5 = 0 then 'speaking_rate_out_of_range' end, case when silence >= 0.7 then 'mostly_silence' end], lambda f: f is not null) as flags,
 (p1 * 0.35::double + p2 * 0.3::double + p3 * 0.15::double + p4 * 0.1::double + p5 * 0.1::double) / (0.35::double + 0.3::double + 0.15::double + 0.1::double + 0.1::double) as weighted from parts),
 punished as (select *, 0.0::double + case when list_contains(flags, 'parentheses') then 0.25 else 0.0 end + case when list_contains(flags, 'digits_or_latin') then 0.15 else 0.0 end + case when list_contains(flags, 'repeated_word') then 0.15 else 0.0 end + case when list_contains(flags, 'empty_asr') then 0.3 else 0.0 end + case when list_contains(flags, 'contains_heading') then 0.05 else 0.0 end as penalty from flagged),
 done as (select *, greatest(0.0, least(1.0, weighted)) as base, greatest(0.0, least(1.0, weighted - penalty)) as conf from punished),
 triaged as (select segment_id, source_chapter, review_status, cast(format('{{:.3f}}', duration) as double) as duration_sec, cast(format('{{:.2f}}', rate) as double) as chars_per_sec, {four('cer')} as cer_vs_asr, {four('moved')} as insert_delete_rate, {four('p1')} as alignment_score, {four('p2')} as agreement_score, {four('p3')} as audio_quality_score, {four('p4')} as duration_score, {four('p5')} as speaking_rate_score,
 {four('penalty')} as artifact_penalty, {four('base')} as base_confidence, {four('conf')} as confidence_score, array_to_string(flags, ';') as triage_flags,
 case when list_has_any(flags, ['empty_candidate', 'duration_out_of_range', 'speaking_rate_out_of_range', 'mostly_silence']) or (base < 0.5 and not list_contains(flags, 'parentheses')) then 'REJECT_CANDIDATE'
 when conf >= 0.9 and not list_has_any(flags, ['parentheses', 'empty_asr', 'empty_candidate', 'duration_out_of_range', 'mostly_silence']) then 'HIGH_CONFIDENCE_CANDIDATE' else 'NEEDS_REVIEW' end as triage_status from done)"""
QUANTILES = "q as (select *, greatest(1, least(floor((n + 1) * 0.1)::bigint, n - 1)) as a, greatest(1, least(floor((n + 1) * 0.5)::bigint, n - 1)) as b, greatest(1, least(floor((n + 1) * 0.9)::bigint, n - 1)) as c from s)"


def quantiles_sql(name: str) -> str:
    at = lambda k, p: four(f"case when n = 1 then v[1] else v[{k}] * (1 - ((n + 1) * {p}::double - {k})) + v[{k} + 1] * ((n + 1) * {p}::double - {k}) end")
    return f"{QUANTILES} select {name}, n, {four('v[1]')} as min, {at('a', 0.1)} as p10, {at('b', 0.5)} as median, {at('c', 0.9)} as p90, {four('v[n]')} as max from q"


WORDS = f"list_filter(string_split({s.stripped_sql('candidate')}, ' '), lambda x: x <> '')"
FLAGS = f"flags as (select conv_id, turn, concat_ws(';', {flags_sql('candidate', 'asr', 'w', 'turn % 3')}) as flags from (select *, {WORDS} as w from turns))"

ORACLE_SQL = {
    "gold_references": f"with {s.GOLD} select segment_id, md5({REFERENCE}) as reference_md5 from gold where {IS_GOLD}",
    "pseudo_eligible": f"with {s.GOLD} select segment_id from gold where {ELIGIBLE}",
    "gold_violations": f"with {s.GOLD}, twice as (select * from gold union all select * replace (seq + 10000000 as seq) from gold where seq % 37 = 0) select segment_id, seq, 'duplicate_segment_id' as error from twice where seq > 9000000 union all {errors_sql('twice')}",
    "seeded_segments": f"""with {s.CHUNK_LOG}, last as (select stem, chunk_index, arg_max(status, seq) as status, arg_max(prediction, seq) as prediction from chunk_log group by 1, 2), named as (select *, stem || '_c' || printf('%03d', chunk_index) as segment_id from last), there as (select distinct stem || '_c' || printf('%03d', chunk_index) as segment_id from chunk_log where seq % 3 = 0)
 select segment_id, '' as source_chapter, null::double as start_sec, null::double as end_sec, '' as raw_asr, '' as provenance from there union all select segment_id, stem, chunk_index * 20.0::double, chunk_index * 20.0::double + 20, trim(prediction), 'asr_chunk_raw:m' from named where status = 'ok' and segment_id not in (select segment_id from there)""",
    "imported_segments": f"with {s.GOLD} select segment_id, source_chapter, '' as source_url, review_status, '' as provenance from gold where seq % 2 = 0 union all select segment_id, source_chapter, 'http://x/' || source_chapter, 'pending_review', 'text_align:m:ctc_viterbi' from gold where seq % 2 <> 0",
    "reviewed_segments": f"""with {s.GOLD}, marked as (select *, review_status = 'pending_review' and start_sec is not null and coalesce(end_sec, 0) > 0 and candidate_text <> '' as mine, seq % 2 = 0 as fixed from gold)
 select segment_id, case when mine then case when fixed then 'needs_correction' else 'rejected' end else decision end as decision, case when mine then case when fixed then 'cd' else 'ab' end else reviewer end as reviewer, case when mine then case when fixed then 'verified' else 'rejected' end else review_status end as review_status,
 case when mine and not fixed then 'a b' else '' end as review_notes, md5(case when mine then case when fixed then 'new' else '' end else corrected_text end) as corrected_md5 from marked""",
    "accepted_decisions": f"with {s.GOLD} select decision, case when decision in ('correct', 'needs_correction') and (seq % 100) / 100.0::double < 0.95 then 'listen to the whole clip before verifying it' end as error, count(*) as n from gold group by 1, 2",
    "evaluation_export": f"with {s.GOLD} select 'evaluation/audio/' || segment_id || '.wav' as audio_path, md5({REFERENCE}) as reference_md5, segment_id, source_chapter, end_sec - coalesce(start_sec, 0.0) as duration_sec from gold where review_status = 'verified' and source_chapter in ('src0', 'src1', 'src2', 'src3', 'src4')",
    "review_queue": f"with {s.GOLD} select segment_id, triage_status, coalesce(confidence::varchar, 'none') as confidence_score from gold order by case triage_status when 'REJECT_CANDIDATE' then 1 when 'HIGH_CONFIDENCE_CANDIDATE' then 2 else 0 end, coalesce(confidence, 0.0), segment_id limit 50",
    "review_progress": f"""with {s.GOLD} select count(*) as total, count(*) filter (where review_status <> 'pending_review') as reviewed, count(*) filter (where decision = 'correct') as verified, count(*) filter (where decision = 'needs_correction') as corrected, count(*) filter (where decision = 'rejected') as rejected,
 count(*) filter (where decision = 'needs_realignment') as needs_realignment, count(*) filter (where review_status = 'pending_review') as remaining, cast(format('{{:.2f}}', sum(case when review_status = 'verified' and end_sec is not null then end_sec - start_sec end) / 60) as double) as verified_minutes,
 count(*) filter (where triage_status = 'HIGH_CONFIDENCE_CANDIDATE') as high_confidence_candidate, count(*) filter (where triage_status = 'NEEDS_REVIEW') as needs_review, count(*) filter (where triage_status = 'REJECT_CANDIDATE') as reject_candidate from gold""",
    "manifest_lines": f'{LINES} select split, audio_filepath, "offset", duration, text_md5, lang, segment_id, label_source from lines',
    "manifest_line_summary": f"{LINES} select split, count(*) as segments, cast(format('{{:.3f}}', sum(duration::decimal(18,3))::double / 3600) as double) as hours, count(distinct source_chapter) as chapters from lines group by 1",
    "manifest_label_counts": f"{LINES} select split, label_source, count(*) as n from lines group by 1, 2",
    "shortest_lines": f"{LINES} select segment_id, duration from lines where duration is not null order by duration, segment_id limit 16",
    "held_out_leaks": f"with {s.GOLD} select distinct source_chapter from gold where seq % 11 = 0 and source_chapter in ('src0', 'src1', 'src2')",
    "bundle_check": f"with {s.GOLD}, {ROUTED.replace('UNVERIFIED', 'false')} select split, count(*) as segments, count(*) filter (where label_source = 'GOLD_CORRECTED') as wrong_language, count(distinct case when source_chapter = 'src3' then audio_filepath end) as missing_audio, {six('sum(duration::decimal(18,3))::double / 3600')} as hours from lines group by 1",
    "chapter_segment_ids": "select 'v' || conv_id as chapter, turn, 'v' || conv_id || '_a' || printf('%03d', row_number() over (partition by conv_id order by turn) - 1) as segment_id from conversations",
    "manifest_violations": f"with {s.MANIFEST} {RULES}",
    "manifest_upsert": f"with {s.MANIFEST}, m as (select *, utterance_id[2:]::bigint as k from manifest), e as (select max(k) as last from m where k % 3 <> 2) select utterance_id, case when k % 2 = 0 then 'new' else transcript end as transcript, case when k % 3 <> 2 then split else 'unassigned' end as split, case when k % 3 <> 2 then k else k + last end as seq from m, e where k % 3 <> 2 or k % 2 = 0",
    "audio_manifest": "select 'P_X_' || o_orderkey as utterance_id, 'file:/a/b/X_' || o_orderkey || '.mp3' as audio_path, 'unknown' as speaker_id, cast(format('{:.3f}', o_totalprice / 1024) as double) as duration_sec, 'not_available' as transcript_status, 'unassigned' as split from orders",
    "customer_splits": f"with {s.MANIFEST}, {SPLIT} select * from splits",
    "manifest_splits": f"with {s.MANIFEST}, {SPLIT}, a as (select m.speaker_id, m.duration_sec, coalesce(s.split, 'train') as split from manifest m left join splits s on m.speaker_id = s.speaker_id) select d.split, count(a.split) as utterances, count(distinct a.speaker_id) as speakers, cast(format('{{:.2f}}', coalesce(sum(a.duration_sec), 0)::double / 60) as double) as minutes from (values ('train'), ('validation'), ('test')) d(split) left join a on a.split = d.split group by 1",
    "customer_leaks": f"with {s.MANIFEST}, m as (select speaker_id, case when utterance_id[-1] < '4' then 'train' when utterance_id[-1] < '7' then 'test' end as split from manifest) select speaker_id, string_agg(distinct split, ';' order by split) as splits from m where speaker_id <> 'unknown' and split is not null group by 1 having count(distinct split) > 1",
    "dataset_statistics": f"with {s.MANIFEST} select count(*) as utterances, cast(format('{{:.1f}}', sum(duration_sec)::double / 60) as double) as minutes, count(distinct case when speaker_id <> 'unknown' then speaker_id end) as known_speakers from manifest",
    "dataset_counts": f"with {s.MANIFEST} select 'domain' as field, domain as value, count(*) as n from manifest group by 2 union all select 'transcript_status', transcript_status, count(*) from manifest group by 2 union all select 'split', split, count(*) from manifest group by 2",
    "dataset_problems": f"""with {s.MANIFEST}, {s.GOLD}, p as (select 'manifest' as kind, error from ({RULES}) union all select 'gold', error from ({errors_sql('gold')}) union all select 'speaker', 'in_splits:' || string_agg(distinct split, ';' order by split) from manifest where speaker_id <> 'unknown' and split in ('train', 'validation', 'test') group by speaker_id having count(distinct split) > 1)
 select kind, error, count(*) as n from p group by 1, 2""",
    "dataset_counters": f"with {s.PREDICTIONS}, p as (select status = 'ok' as good, seq % 4 > 0 and trim(reference) <> '' as told, duration_sec from predictions) select count(*) as total, count(*) filter (where good) as valid, count(*) filter (where not good) as invalid, count(*) filter (where told) as with_reference, count(*) filter (where not told) as without_reference, cast(format('{{:.1f}}', sum(case when good then duration_sec end) / 60) as double) as minutes from p",
    "sorted_manifest": f"with {s.MANIFEST} select utterance_id, speaker_id, row_number() over (order by utterance_id) as place from manifest",
    "pseudonyms": f"""with old as (select 'VH_S' || lpad(c_custkey::varchar, 6, '0') as id, {HASHED} as h, c_custkey from customer where c_custkey % 10 < 2), hashed as (select c_custkey, {HASHED} as h from customer), new as (select h, row_number() over (order by c_custkey) as n from hashed where h not in (select h from old where c_custkey % 10 = 0)), top as (select max(c_custkey) as m from old),
 named as (select hashed.c_custkey as c_custkey, coalesce(o.id, 'VH_S' || printf('%03d', new.n + top.m)) as speaker_id from hashed left join old o on hashed.h = o.h and o.c_custkey % 10 = 0 left join new on hashed.h = new.h, top) select c_custkey as seq, speaker_id from named union all select c_custkey + 1000000, speaker_id from named""",
    "key_hashes": f"select c_custkey, {HASHED} as key_hash from customer",
    "gated_recordings": f"with {s.MANIFEST}, g as (select case when consent_status <> 'given' then 'recording rejected: informed consent not given' when domain = 'low' then 'recording rejected: zero-length audio' when not (duration_sec * 3)::double between 0.5 and 600 then 'recording rejected: duration N outside [0.5, 600.0]' end as rejected from manifest) select rejected, count(*) as n from g group by 1",
    "registered_recordings": f"""with {s.MANIFEST}, {s.SIGNALS}, taken as (select speaker_id, max(utterance_id[-3:]::bigint) as top from manifest group by 1), new as (select 'VH_S' || lpad((vec_id % 50 + 1)::varchar, 6, '0') as speaker_id, vec_id, {square_sql('samples')} as power, len(list_filter(samples, lambda x: abs(x) >= 0.999::float)) / len(samples) as clip from signals),
 placed as (select *, row_number() over (partition by speaker_id order by vec_id) as n from new), named as (select p.*, p.speaker_id || '_' || printf('%04d', n + coalesce(top, 0)) as utterance_id, case when power > 0 then 20 * log10(sqrt(power)) end as db from placed p left join taken t on p.speaker_id = t.speaker_id)
 select utterance_id, 'recordings/' || speaker_id || '/' || utterance_id || '.wav' as audio_path, case when vec_id % 2 = 0 then 'pending_review' else 'not_available' end as transcript_status, case when clip > 0.001 or db is null or db < -40 then 'poor' when db < -30 then 'fair' else 'good' end as recording_quality from named""",
    "withdrawal": f"with {s.MANIFEST} select case when speaker_id = 'VH_S000001' then 'withdrawn' else 'active' end as status, count(distinct speaker_id) as speakers, count(distinct case when speaker_id = 'VH_S000001' then speaker_id end) as blank, (select count(*) from manifest where speaker_id <> 'VH_S000001') as n from manifest group by 1",
    "triage_scores": f"{TRIAGE} select * exclude (source_chapter, review_status) from triaged",
    "triage_status_counts": f"{TRIAGE} select d.value, count(t.segment_id) as n from (values ('HIGH_CONFIDENCE_CANDIDATE'), ('NEEDS_REVIEW'), ('REJECT_CANDIDATE')) d(value) left join triaged t on t.triage_status = d.value group by 1",
    "triage_by_chapter": f"{TRIAGE} select source_chapter, count(*) filter (where triage_status = 'HIGH_CONFIDENCE_CANDIDATE') as \"HIGH_CONFIDENCE_CANDIDATE\", count(*) filter (where triage_status = 'NEEDS_REVIEW') as \"NEEDS_REVIEW\", count(*) filter (where triage_status = 'REJECT_CANDIDATE') as \"REJECT_CANDIDATE\" from triaged group by 1",
    "triage_flag_counts": f"{TRIAGE} select flag, count(*) as n from (select unnest(string_split(triage_flags, ';')) as flag from triaged) where flag <> '' group by 1",
    "triage_review_counts": f"with {s.GOLD} select review_status, count(*) as n from gold group by 1",
    "triage_distributions": f"{TRIAGE}, long as (unpivot (select {', '.join(triage.SUMMARISED)} from triaged) on {', '.join(triage.SUMMARISED)} into name name value value), s as (select name, list(value order by value) as v, count(*) as n from long group by 1), {quantiles_sql('name')}",
    "triage_updates": f"{TRIAGE} select case when g.source_chapter = 'src0' then 'triage-v1' else '' end as triage_version, case when g.source_chapter = 'src0' then t.triage_status else g.triage_status end as triage_status, count(*) as n from gold g join triaged t on g.segment_id = t.segment_id group by 1, 2",
    "flags_of_turns": f"with {s.TURNS}, {FLAGS} select * from flags",
    "flag_counts": f"with {s.TURNS}, {FLAGS} select flag, count(*) as n from (select unnest(string_split(flags, ';')) as flag from flags) where flag <> '' group by 1",
    "speaking_rates": f"with {s.PAIRS} select doc_id, {four(f"case when doc_id % 9 > 0 and n_chars > 0 then length(replace({s.stripped_sql('reference')}, ' ', '')) / (n_chars / 9.0::double) else 0.0 end")} as rate from pairs",
    "event_value_quantiles": f"with s as (select event_type, list(value order by value) as v, count(*) as n from events where value is not null group by 1), {quantiles_sql('event_type')}",
    "event_type_counts": "select d.value, count(e.event_id) as n from (values ('click'), ('view'), ('purchase'), ('error'), ('never')) d(value) left join events e on e.event_type = d.value group by 1",
    "status_by_priority": 'select o_orderpriority, count(*) filter (where o_orderstatus = \'F\') as "F", count(*) filter (where o_orderstatus = \'O\') as "O", count(*) filter (where o_orderstatus = \'P\') as "P" from orders group by 1',
}

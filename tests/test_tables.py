"""Files, rules and guards: what is refused, what is written, and what is left as it was."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import scores, text
from tessera.functions.numbers import exact_round
from tessera.operators import chapters, evaluation, gold, logs, manifests, shared, speakers, splits, triage
from tessera.operators.numbering import numbered
from tessera.sources import audio, tables

GOLD = "segment_id string, source_chapter string, start_sec string, end_sec string, candidate_text string, raw_asr string, decision string, corrected_text string, reviewer string, review_status string, reviewed_at string, review_notes string, triage_status string, seq long"


def segment(key, status="pending_review", decision="", reviewer="", corrected="", candidate="words", start="0", end="2", seq=0):
    return (key, "c", start, end, candidate, "asr", decision, corrected, reviewer, status, "", "", "", seq)


def test_rules_of_segments(spark):
    rows = [segment("a"), segment("a", seq=1), segment("b", "odd"), segment("c", "verified", "correct", "r", candidate=" "), segment("d", "verified", "needs_correction", "r", " "), segment("e", "rejected"), segment("f", start=""), segment("g", start="3"), segment("h", "rejected", "correct", "r")]
    found = {(r["segment_id"], r["error"]) for r in gold.violations(spark.createDataFrame(rows, GOLD), "seq").collect()}
    assert found == {("a", "duplicate_segment_id"), ("b", "unknown_status"), ("b", "review_incomplete"), ("c", "candidate_missing"), ("d", "correction_missing"), ("e", "review_incomplete"), ("f", "one_bound_only"), ("g", "end_not_after_start"), ("h", "decision_does_not_match")}
    with pytest.raises(gold.Rejected):
        gold.checked(spark.createDataFrame(rows, GOLD), "seq")


def decision(spark, *rows):
    return spark.createDataFrame([(*r, "t", k) for k, r in enumerate(rows)], "segment_id string, decision string, reviewer string, corrected_text string, notes string, reviewed_at string, seq long")


def test_reviews(spark):
    rows = spark.createDataFrame([segment("a"), segment("b", seq=1)], GOLD)
    done = gold.reviewed(rows, decision(spark, ("a", "VERIFIED", "rv", "", ""), ("a", "CORRECTED", " rv ", " new ", " n  m ")), "seq")
    again = gold.reviewed(done, decision(spark, ("a", "CORRECTED", "rv", "new", "n m")), "seq")
    a, b = again.orderBy("segment_id").collect()
    assert (a["review_status"], a["corrected_text"], a["reviewer"], a["review_notes"], a["candidate_text"]) == ("verified", "new", "rv", "n m", "words") and b["review_status"] == "pending_review"
    for bad in (("a", "maybe", "rv", "", ""), ("a", "correct", "a name", "", ""), ("x", "correct", "rv", "", ""), ("a", "needs_correction", "rv", " ", "")):
        with pytest.raises(gold.Rejected):
            gold.reviewed(rows, decision(spark, bad), "seq")
    for name in ("9a", "a", "a b", "+91", "a" * 21):
        assert not spark.range(1).select(text.is_reviewer(F.lit(name)).alias("x")).first()["x"]


def test_scores_need_a_verified_reference(spark):
    told = spark.createDataFrame([("p1", "no", "a b", 1.0, "ok", 0), ("p2", "", "c", 1.0, "failed", 1), ("p3", "x", "x", 1.0, "ok", 2)], "audio_path string, reference string, prediction string, duration_sec double, status string, seq long")
    known = spark.createDataFrame([("p1", "old", 1.0, "s", "g1", 0), ("p1", "a c", 9.0, "s", "g1", 1), ("p2", "c", 9.0, "s", "g2", 2)], "audio_path string, reference_text string, duration_sec double, speaker_id string, segment_id string, seq long")
    m = evaluation.gold_scores(told, known, "m", ["c"]).metrics.first()
    assert (m["evaluated_samples"], m["wer"], m["evaluated_minutes"], m["label"]) == (1, 0.5, 0.15, "PILOT EVALUATION")
    with pytest.raises(evaluation.NothingScored):
        evaluation.gold_scores(told, known.filter("segment_id = 'g2'"), "m", ["c"])


def test_comparison_needs_one_test_set(spark):
    run = lambda ids, wer: (spark.createDataFrame([(wer, "FINAL EVALUATION")], "wer double, label string"), spark.createDataFrame([(i,) for i in ids], "segment_id string"))
    found, label = evaluation.comparison(run("ab", 0.5), run("ba", 0.35), ("wer",))
    assert label == "FINAL" and found.first()["difference_b_minus_a"] == -0.15
    with pytest.raises(evaluation.DifferentTestSets):
        evaluation.comparison(run("ab", 0.5), run("ac", 0.3), ("wer",))


def test_splits_are_guarded(spark):
    rows = spark.createDataFrame([(f"u{i}_{k}", f"VH_S{i:03d}" if i else "unknown", "10" if k else None) for i in range(11) for k in range(3)] + [("n", None, "x")], "utterance_id string, speaker_id string, duration_sec string")
    done = splits.assigned(rows, "speaker_id", "duration_sec")
    assert done.count() == 34 and manifests.leaks(done.filter("speaker_id is not null")).count() == 0
    assert {r["split"] for r in done.filter("speaker_id = 'unknown'").collect()} == {"train"} and {r["split"] for r in done.collect()} == {"train", "validation", "test"}
    assert sorted(map(tuple, splits.assigned(rows, "speaker_id", "duration_sec").collect()), key=str) == sorted(map(tuple, done.collect()), key=str)
    leaking = done.withColumn("split", F.when(F.col("utterance_id").endswith("0"), "test").otherwise("train"))
    with pytest.raises(manifests.Invalid):
        tables.write_splits(leaking, shared.fresh_path(spark, "t"))
    with pytest.raises(ValueError):
        splits.assigned(rows, "speaker_id", "duration_sec", (0.5, 0.1, 0.1))


def test_manifests_are_written_whole_or_not(spark):
    path = shared.fresh_path(spark, "m")
    bad = spark.createDataFrame([("u", "unknown")], "utterance_id string, speaker_id string")
    assert {r["error"] for r in manifests.violations(bad).collect()} >= {"missing_split", "missing_domain"}
    with pytest.raises(manifests.Invalid):
        tables.write_manifest(bad, path)
    assert not tables.exists(spark, path)
    with pytest.raises(ValueError):
        tables.write_csv(bad, path, ("utterance_id",))


def test_state_files(spark):
    root = shared.fresh_path(spark, "s")
    tables.write_json(spark, f"{root}/a.json", {"completed": ["x"]})
    assert tables.read_json(spark, f"{root}/a.json", None) == {"completed": ["x"]}
    spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.text(f"{root}/b")
    assert tables.read_json(spark, f"{root}/b", "default") == "default" and tables.read_failed(spark, f"{root}/a.json").count() == 0
    assert tables.read_chapter_metadata(spark, f"{root}/none.json").count() == 0


def test_pseudonyms_need_a_salt_and_are_never_used_again(spark):
    with pytest.raises(ValueError):
        speakers.key_hash(F.lit("x"), "")
    import hashlib
    import hmac
    from datetime import date

    for salt in ("pepper", "p" * 100):
        got = spark.range(1).select(speakers.key_hash(F.lit(" Ab "), salt).alias("h")).first()["h"]
        assert got == hmac.new(salt.encode(), b"ab", hashlib.sha256).hexdigest()
    empty = spark.createDataFrame([], "speaker_id string, key_hash string, status string, registered_on date")
    people = spark.createDataFrame([("A", 1), (" a", 2), ("b", 0)], "speaker_key string, seq long")
    rows, registry = speakers.identified(people, empty, "s", "seq", date(2020, 1, 1))
    assert {r["seq"]: r["speaker_id"] for r in rows.collect()} == {0: "VH_S001", 1: "VH_S002", 2: "VH_S002"}
    _, gone = speakers.withdrawn({}, registry, "VH_S002")
    rows, after = speakers.identified(people, gone, "s", "seq", date(2020, 1, 2))
    assert {r["seq"]: r["speaker_id"] for r in rows.collect()} == {0: "VH_S001", 1: "VH_S003", 2: "VH_S003"} and after.count() == 3


def test_triage_of_malformed_rows(spark):
    rows = spark.createDataFrame([("a", None, "", "x", "1", "", None), ("b", "some words here", "some words here", "0.000", "11.000", "-0.3", (0.1, 0.0, -18.0))], "segment_id string, candidate_text string, raw_asr string, start_sec string, end_sec string, align_score string, audio struct<silence_ratio:double,clip_ratio:double,rms_dbfs:double>")
    a, b = triage.told(triage.scored(rows)).orderBy("segment_id").collect()
    assert a["triage_flags"].split(";") == ["empty_candidate", "empty_asr", "missing_align_score", "audio_unavailable", "duration_out_of_range", "speaking_rate_out_of_range"] and a["triage_status"] == "REJECT_CANDIDATE"
    assert b["cer_vs_asr"] == 0.0 and b["alignment_score"] == 1.0 and b["audio_quality_score"] == 1.0
    with pytest.raises(ValueError):
        scores.DEFAULTS.with_thresholds(high_confidence=0.4)


def test_blank_texts_and_numbers(spark):
    values = spark.createDataFrame([("\t\n",), ("\x1c  ",), ("a",), (None,)], "t string").select(text.is_blank(F.col("t")).alias("b")).collect()
    assert [r["b"] for r in values] == [True, True, False, True]
    given = ["1_0", "1.5d", " 2. ", "nan", "-inf", "", "1e3", "0x1", ".5"]
    got = [r["v"] for r in spark.createDataFrame([(g,) for g in given], "t string").select(text.number(F.col("t")).alias("v")).collect()]
    assert got[:3] == [10.0, None, 2.0] and got[3] != got[3] and got[4:] == [float("-inf"), None, 1000.0, None, 0.5]
    sample = [2.675, 0.5, 1.5, 5e-05, -2.5, 1e17, 0.125, 1.005, None]
    for n in (0, 2, 4):
        got = [r["v"] for r in spark.createDataFrame([(x,) for x in sample], "x double").select(exact_round(F.col("x"), n).alias("v")).collect()]
        assert got == [None if x is None else round(x, n) for x in sample]


def test_numbers_in_order_and_logs(spark):
    rows = numbered(spark.range(1000).selectExpr("(id * 7919) % 1000 as k"), "k", "n").collect()
    assert {r["k"]: r["n"] for r in rows} == {k: k + 1 for k in range(1000)}
    assert numbered(spark.range(0).withColumnRenamed("id", "k"), "k", "n").count() == 0
    log = spark.createDataFrame([("a", 1, "ok"), ("a", 2, "failed"), ("b", 3, "ok"), ("", 4, "ok")], "k string, seq long, status string")
    assert [r["k"] for r in logs.latest_wins(log, "k", F.col("seq"), F.col("status") == "ok").orderBy("k").collect()] == ["", "b"]
    assert [(r["k"], r["seq"], r["place"]) for r in logs.keep_last_at_first(log, "k", "seq").orderBy("k").collect()] == [("a", 2, 1), ("b", 3, 3)]


def test_media(spark):
    with pytest.raises(ValueError):
        chapters.all_chapters(spark, "X", books={"A": 2}, total=3)
    with pytest.raises(ValueError):
        chapters.chosen(spark.range(1), book="A", chapter_id="A.1.X")
    raw = audio.wav_bytes([0.5, -0.5] * 800, 8000)
    rows = spark.createDataFrame([("a", bytearray(raw)), ("b", bytearray(b"junk")), ("c", bytearray(audio.wav_bytes([], 8000)))], "path string, content binary")
    a, b, c = audio.decoded_rows(rows).orderBy("path").collect()
    assert (a["rate"], len(a["samples"]), a["valid"]) == (16000, 3200, True) and not b["valid"] and b["reason"].startswith("could not decode") and c["reason"] == "zero-length audio"
    import numpy as np

    slow = np.sin(np.arange(4000) * 2 * np.pi * 100 / 8000).astype(np.float32)
    fast = audio.resampled(slow, 8000, 16000)
    assert abs(fast[200:-200] - np.sin(np.arange(8000) * 2 * np.pi * 100 / 16000)[200:-200]).max() < 1e-3

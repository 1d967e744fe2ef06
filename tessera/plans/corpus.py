"""Queries of logs and state, chapters and media, signals, alignment, pages, files and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scores, signals, text
from tessera.functions.numbers import exact_round
from tessera.operators import chapters, chunks, ctc, evaluation, html_units, logs, manifests, prompts, shared, splits
from tessera.plans import scoring
from tessera.plans import surrogates as s
from tessera.plans.segments import AUDIO as AUDIO_SQL
from tessera.plans.segments import SPLIT, four, plateau_sql, ramp_sql, square_sql
from tessera.sources import audio, reports, tables
from tessera.streaming import chunk_log

CODE = "XYZ"


def latest_ok_events(spark, d):
    rows = s.table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return logs.latest_wins(rows, "user_id", F.col("event_id"), F.col("event_type") != "error")


def latest_ok_chunks(spark, d):
    return chunks.resumable(s.chunk_log(spark, d).select("stem", "chunk_index", "seq", "status"), "stem")


def users_with_any_ok(spark, d):
    return logs.any_ok(s.table(spark, d, "events"), "user_id", F.col("event_type") == "purchase")


def last_event_at_first_place(spark, d):
    return logs.keep_last_at_first(s.table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


def orders_to_do(spark, d):
    done = logs.any_ok(s.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", F.col("l_linestatus") == "F")
    return logs.to_do(s.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), done, "o_orderkey")


def failed_again(spark, d):
    failed = s.table(spark, d, "events").filter("event_type = 'error'").select(F.col("user_id").alias("c_custkey"))
    return logs.retried(s.table(spark, d, "customer").select("c_custkey", "c_name"), failed, "c_custkey")


def metadata_updates(spark, d):
    rows = s.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderkey").alias("seq"))
    return logs.moved_to_end(rows, rows.filter("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("N")), "o_orderkey", "seq")


def reused_chunks(spark, d):
    log = s.chunk_log(spark, d)
    plan = log.select("stem", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("chunk_index")).distinct()
    return logs.reused(plan, chunks.resumable(log, "stem"), ["stem", "chunk_index"])


def finished_recordings(spark, d):
    """Recordings as stitched texts of their chunks, failed where the last try of a chunk failed."""
    last = logs.latest_wins(s.chunk_log(spark, d).select("stem", "chunk_index", "seq", "prediction", "status"), ["stem", "chunk_index"], F.col("seq"))
    return chunks.batch_results(last, "stem", overlapping=False).select("stem", F.md5("prediction").alias("prediction_md5"), "status", "error_message")


def all_chapters(spark, d):
    return chapters.all_chapters(spark, CODE, "http://x/1")


def chapter_ids(spark, d):
    n = F.col("o_orderkey")
    odd = F.when(n % 7 == 0, "JHN.3.XYZ").when(n % 7 == 1, "JHN.22.XYZ").when(n % 7 == 2, "ABC.1.XYZ").when(n % 7 == 3, "JHN.x.XYZ").when(n % 7 == 4, "JHN.3").when(n % 7 == 5, "REV. 22.XYZ").otherwise("JHN.3.ABC")
    return chapters.parsed_ids(s.table(spark, d, "orders").select("o_orderkey", odd.alias("id")), "id", CODE).withColumn("chapter", F.col("chapter").cast("string"))


def chosen_chapters(spark, d):
    every = chapters.all_chapters(spark, CODE)
    failed = s.table(spark, d, "events").filter("event_type = 'error'").select(F.concat(F.lit("MAT."), (F.col("user_id") % 40).cast("string"), F.lit(".XYZ")).alias("chapter"))
    return chapters.chosen(every, failed=failed).select("chapter_id", F.lit("failed").alias("why")).unionByName(chapters.chosen(every, book="JUD").unionByName(chapters.chosen(every, book="JAS")).select("chapter_id", F.lit("book").alias("why")))


def media_kinds(spark, d):
    return chapters.classified(s.resources(spark, d)).select("seq", "kind")


def best_resources(spark, d):
    return chapters.best_resource(chapters.classified(s.resources(spark, d)), "chapter", "seq").select("chapter", "seq", "kind")


def mp3_checks(spark, d):
    n = F.col("doc_id")
    head = F.when(n % 4 == 0, F.unhex(F.lit("494433"))).when(n % 4 == 1, F.unhex(F.lit("FFE3"))).when(n % 4 == 2, F.unhex(F.lit("FF1F"))).otherwise(F.unhex(F.lit("")))
    rows = s.table(spark, d, "documents").select("doc_id", F.concat(head, F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("content"))
    error = chapters.mp3_error(F.col("content"), F.octet_length("content"), least=1000)
    return rows.select("doc_id", error.alias("error"))


def attempts(spark, d):
    rows = s.table(spark, d, "events").filter("user_id is not null").select((F.col("user_id") % 300).alias("chapter"), F.pmod(F.col("event_id"), F.lit(4)).alias("attempt"), F.when(F.col("event_type") != "purchase", F.col("event_type")).alias("error"), "event_id")
    return logs.latest_wins(rows.filter("attempt > 0"), ["chapter", "attempt"], F.col("event_id"))


def download_outcomes(spark, d):
    return chapters.outcomes(attempts(spark, d))


def download_states(spark, d):
    every = chapters.all_chapters(spark, CODE)
    found = chapters.outcomes(attempts(spark, d)).withColumn("chapter", F.concat(F.lit("MAT."), F.col("chapter").cast("string"), F.lit(".XYZ")))
    files = every.filter("chapter % 3 = 0").select("filename", F.when(F.col("chapter") % 2 == 0, "file is too small").alias("error"))
    done, failed = chapters.download_state(every, files, found, every.filter("chapter = 9").select("chapter_id"))
    return done.select("chapter_id", F.lit("done").alias("state")).unionByName(failed.select(F.col("chapter").alias("chapter_id"), F.lit("failed").alias("state")))


def download_totals(spark, d):
    states = s.table(spark, d, "events").select(F.when(F.col("event_type") == "purchase", "downloaded").when(F.col("event_type") == "view", "skipped").when(F.col("event_type") == "error", "failed").otherwise("remaining").alias("state"))
    return chapters.download_summary(states)


def chapter_records(spark, d):
    every = chapters.all_chapters(spark, CODE)
    old = every.filter("chapter <= 3").select("chapter_id", "book", "chapter", "url", F.lit("old").alias("audio_file"), F.col("position").cast("long").alias("seq"))
    return chapters.recorded(old, every.filter("chapter % 2 = 0"), "seq").select("chapter_id", "audio_file")


def relative_paths(spark, d):
    n = F.col("o_orderkey").cast("string")
    made = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("/w/repo/a/"), n)).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("/w/repo\\a\\"), n)).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("./a//b/../"), n)).otherwise(F.concat(F.lit("/else/"), n))
    return s.table(spark, d, "orders").select("o_orderkey", text.relative_path(made, "/w/repo").alias("path"))


def session_sheet(spark, d):
    rows = s.table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.format_string("P%06d", "p_partkey").alias("prompt_id"), F.when(F.col("p_size") % 2 == 0, "read").otherwise("elicitation").alias("type"), F.col("p_brand").alias("topic"), F.concat(F.lit("crop"), (F.col("p_size") % 5).cast("string")).alias("crop"), F.col("p_name").alias("text"), F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("new "), "p_name")).otherwise(" ").alias("rewritten"))
    sheet, skipped = prompts.session_sheet(rows, ["crop1", "crop2"], ["crop4"], "rewritten", "seq")
    return sheet.select("order", "prompt_id", "show_text", "expected_read_text").unionByName(skipped.select(F.lit(0).alias("order"), "prompt_id", F.lit("").alias("show_text"), F.lit("").alias("expected_read_text")))


def stripped_texts(spark, d):
    plain = text.strip_punctuation(F.coalesce("text", F.lit("")))
    rows = s.table(spark, d, "documents").select("doc_id", plain.alias("stripped"))
    return rows.select("doc_id", F.size(text.words("stripped")).cast("long").alias("n_words"), F.char_length(F.replace("stripped", F.lit(" "), F.lit(""))).cast("long").alias("n_marks"), F.md5("stripped").alias("stripped_md5"))


def collapsed_texts(spark, d):
    return s.table(spark, d, "documents").select("doc_id", F.md5(text.collapsed(F.coalesce("text", F.lit("")))).alias("collapsed_md5"), text.is_blank(F.col("text")).alias("blank"))


def names_checked(spark, d):
    n = F.col("c_custkey")
    name = F.when(n % 5 == 0, F.concat(F.lit(" a"), n.cast("string"))).when(n % 5 == 1, F.concat(F.lit("VH_S"), n.cast("string"))).when(n % 5 == 2, "unknown").when(n % 5 == 3, "a b").otherwise(F.concat(n.cast("string"), F.lit("x")))
    return s.table(spark, d, "customer").select("c_custkey", text.is_reviewer(name).alias("reviewer"), text.is_speaker(name).alias("speaker"))


def parsed_numbers(spark, d):
    n = F.col("o_orderkey").cast("string")
    made = F.when(F.col("o_orderkey") % 6 == 0, F.concat(F.lit(" "), n, F.lit(".50 "))).when(F.col("o_orderkey") % 6 == 1, F.concat(F.lit("-."), n)).when(F.col("o_orderkey") % 6 == 2, F.concat(n, F.lit("d"))).when(F.col("o_orderkey") % 6 == 3, F.concat(F.lit("1_0"), n)).when(F.col("o_orderkey") % 6 == 4, F.concat(n, F.lit("e-2"))).otherwise("")
    return s.table(spark, d, "orders").select("o_orderkey", text.number(made).alias("value"))


def rounded_values(spark, d):
    return s.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", exact_round(F.col("l_extendedprice") / 7, 2).alias("two"), exact_round(-F.col("l_quantity") / 16, 3).alias("three"), exact_round(F.col("l_discount") / 8, 1).alias("one"))


def class_suffixes(spark, d):
    rows = s.table(spark, d, "part").select("p_partkey", F.concat(F.replace("p_type", F.lit(" "), F.lit("__")), F.lit("  x_y "), "p_brand").alias("c"))
    return rows.select("p_partkey", F.array_join(text.class_suffixes(F.col("c")), ";").alias("suffixes"))


def ramps(spark, d):
    value = F.when(F.col("event_id") % 11 > 0, F.col("value"))
    return s.table(spark, d, "events").select("event_id", exact_round(scores.ramp(value, 90.0, 10.0), 6).alias("ramp"), exact_round(scores.plateau(F.coalesce("value", F.lit(0.0)), (5.0, 20.0, 60.0, 90.0)), 6).alias("plateau"))


def signal_levels(spark, d):
    found = s.signals(spark, d).select("vec_id", signals.audio_signals(F.col("samples"), signals.frame_of(F.col("rate"))).alias("a"))
    return found.select("vec_id", *[exact_round(F.col(f"a.{c}"), 4).alias(c) for c in ("silence_ratio", "clip_ratio", "rms_dbfs")])


def signal_quality(spark, d):
    return s.signals(spark, d).select("vec_id", signals.recording_quality(F.col("samples")).alias("quality"))


def signal_clips(spark, d):
    cut = signals.clip(F.col("samples"), F.col("rate"), F.when(F.col("vec_id") % 3 > 0, F.lit(0.05)), F.when(F.col("vec_id") % 4 > 0, F.lit(0.15)))
    found = s.signals(spark, d).select("vec_id", cut.alias("cut"))
    return found.select("vec_id", F.size("cut").cast("long").alias("n"), exact_round(F.aggregate("cut", F.lit(0.0), lambda a, x: a + x), 4).alias("sum"))


SETTINGS = chunks.ChunkSettings(target_sec=0.06, max_sec=0.12, overlap_sec=0.0)


def planned_chunks(spark, d):
    found = chunks.planned(s.signals(spark, d), "vec_id", "samples", "rate", SETTINGS)
    return found.select("vec_id", "chunk_index", "start", "end", exact_round(F.col("start_sec"), 6).alias("start_sec"), exact_round(F.col("end_sec"), 6).alias("end_sec"))


def chunked_predictions(spark, d):
    """Chunks by a given function, of which those in a log are not made again; the function fails on loud signals."""
    sound = s.signals(spark, d)
    plan = chunks.planned(sound, "vec_id", "samples", "rate", SETTINGS)
    done = plan.filter("vec_id % 2 = 0 and chunk_index = 0").select("vec_id", "chunk_index", F.lit("old").alias("prediction"))

    def said(samples, rate):
        if abs(samples).max() >= 0.999:
            raise ValueError("too loud")
        return f"n{len(samples)}"

    made = chunks.transcribed(plan, sound, "vec_id", said, done)
    return chunks.batch_results(made, "vec_id", overlapping=False)


def stitched_turns(spark, d):
    turns = s.table(spark, d, "conversations").select("conv_id", "turn", "text")
    found = chunks.stitched_texts(turns, "conv_id", "turn", "text", overlapping=True)
    return found.select("conv_id", F.md5("text").alias("text_md5"))


def unit_groups(spark, d):
    found = chunks.unit_groups(s.units(spark, d), "conv_id", "turn", s.LONGEST)
    return found.select("conv_id", "place", "first", "last", exact_round(F.col("start"), 6).alias("start"), exact_round(F.col("end"), 6).alias("end"))


def frame_scores(spark, d):
    """8 x 8 log-probabilities of each vector, with tokens by its label."""
    rows = s.table(spark, d, "embeddings").filter("embedding is not null")
    matrix = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 8 + 1, F.lit(8)))
    logged = F.transform(matrix, lambda r: F.transform(r, lambda x: x - F.log(F.aggregate(r, F.lit(0.0), lambda a, y: a + F.exp(y)))))
    tokens = F.array(F.pmod(F.col("label"), F.lit(7)), F.pmod(F.col("label") + 3, F.lit(7)), F.pmod(F.col("label"), F.lit(7)))
    return rows.select("vec_id", logged.alias("log_probs"), F.when(F.col("vec_id") % 10 == 0, F.array().cast("array<int>")).otherwise(tokens.cast("array<int>")).alias("tokens"))


def aligned_tokens(spark, d):
    found = ctc.aligned(frame_scores(spark, d), "vec_id", s.BLANK)
    return found.select("vec_id", F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["first"].cast("string"), x["last"].cast("string"))), ",").alias("spans"), exact_round(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x), 4).alias("score"), "error")


def greedy_symbols(spark, d):
    return frame_scores(spark, d).select("vec_id", F.array_join(ctc.greedy_ids(F.col("log_probs"), s.BLANK).cast("array<string>"), ",").alias("ids"))


def chapter_segments(spark, d):
    rows = frame_scores(spark, d).filter("size(tokens) > 0")
    unit = lambda k, kind: F.struct(F.lit(kind).alias("kind"), F.lit("" if kind == "heading" else f"v{k}").alias("ref"), F.lit(f"word{k}").alias("text"), F.array(F.get("tokens", F.lit(k))).alias("tokens"))
    full = rows.select("vec_id", "log_probs", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: i * 0.5).alias("times"), F.lit(0.5).alias("frame_sec"), F.array(unit(0, "heading"), unit(1, "verse"), unit(2, "verse")).alias("units"))
    found = ctc.chapter_segments(full, "vec_id", s.BLANK, lambda ids: " ".join(f"word{i}" for i in ids), longest=2.0)
    return found.select("vec_id", "segment_id", "start_sec", "end_sec", "units", "n_headings", "text", "align_score", "raw_asr", "error")


def page_units(spark, d):
    """Pages with the class names of chapter pages in place of their own."""
    page = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", "<h1", '<h1 class="c__s"'), "<p", '<p class="x__verse y__content" data-usfm="P.1"'), "<nav", '<nav class="z__note"')
    found = html_units.page_units(s.table(spark, d, "pages").select("page_id", page.alias("html")), "page_id", "html")
    return found.select("page_id", "place", "kind", "ref", F.md5("text").alias("text_md5"))


def wav_round_trip(spark, d):
    """Signals as WAV bytes, read back."""
    made = s.signals(spark, d).select(F.col("vec_id").cast("string").alias("path"), F.when(F.col("vec_id") % 13 > 0, audio.encoded(F.col("samples"), F.lit(16000))).alias("content"))
    found = audio.decoded_rows(made)
    return found.select(F.col("path").cast("long").alias("vec_id"), F.coalesce("rate", F.lit(0)).alias("rate"), F.coalesce(F.size("samples"), F.lit(0)).cast("long").alias("n"), "duration_sec", "valid", "reason")


def wav_clips(spark, d):
    sound = s.signals(spark, d).select(F.col("vec_id").cast("string").alias("path"), "samples", F.col("rate"))
    parts = sound.select(F.concat(F.lit("g"), "path").alias("segment_id"), F.col("path").alias("audio_path"), F.lit("0.05").alias("start_sec"), F.when(F.col("path").cast("long") % 2 == 0, "0.1").otherwise("").alias("end_sec"))
    return audio.clips(parts, sound).select("segment_id", F.length("wav").cast("long").alias("n_bytes"), "duration_sec")


def csv_round_trip(spark, d):
    """Predictions as CSV with line breaks and quotes in them, read back; a column that isn't there is empty, as is a missing file."""
    path = shared.fresh_path(spark, "csv")
    rows = s.predictions(spark, d).select("audio_path", F.concat(F.lit('say "'), "reference", F.lit('",\nthen')).alias("reference"), "prediction", F.col("duration_sec").cast("string").alias("duration_sec"), "status")
    tables.write_csv(rows, path, ("audio_path", "reference", "prediction", "duration_sec", "status"))
    back = tables.read_csv(spark, path, tables.PREDICTIONS).unionByName(tables.read_or_empty(spark, path + "-none", tables.PREDICTIONS))
    return back.select("audio_path", F.md5("reference").alias("reference_md5"), "error_message", "status")


def metadata_or_listing(spark, d):
    """Samples: from the metadata where it has rows, else from the audio files."""
    path = shared.fresh_path(spark, "audio")
    s.signals(spark, d).filter("vec_id < 20").select(F.lit("x").alias("value")).coalesce(1).write.text(path)
    return tables.samples(spark, path + "/none.csv", path + "/*.txt").select(F.regexp_extract("audio_path", "[.][a-z]+$", 0).alias("kind"), "reference_text", "speaker_id")


def chunk_folder(spark, d):
    """Chunk logs, one folder of CSV for each of a few stems, read as one table."""
    root = shared.fresh_path(spark, "chunks")
    rows = s.chunk_log(spark, d).select(*[F.col(c).cast("string") if c in ("chunk_index",) else (F.col(c) if c in ("prediction", "status") else F.lit("").alias(c)) for c in tables.CHUNKS])
    rows.write.option("header", "true").csv(root)
    found = tables.read_folder(spark, f"{root}/*.csv", tables.CHUNKS)
    return found.groupBy("status", "chunk_index").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("stem") != "").alias("named"))


def state_files(spark, d):
    """State as JSON, replaced, read back; broken and missing files are empty."""
    root = shared.fresh_path(spark, "state")
    tables.write_json(spark, f"{root}/progress.json", {"completed": ["old"]})
    tables.write_json(spark, f"{root}/broken.json", [1, 2])
    tables.write_completed(spark.createDataFrame([("b",), ("a",), ("b",)], "chapter_id string"), f"{root}/progress.json")
    tables.write_failed(spark.createDataFrame([("c", "old", 1, 0), ("c", "r", 3, 1)], "chapter string, reason string, attempts int, seq long"), f"{root}/failed.json")
    done = tables.read_completed(spark, f"{root}/progress.json").unionByName(tables.read_completed(spark, f"{root}/broken.json")).unionByName(tables.read_completed(spark, f"{root}/missing.json"))
    failed = tables.read_failed(spark, f"{root}/failed.json").unionByName(tables.read_failed(spark, f"{root}/broken.json"))
    return done.select(F.col("chapter_id").alias("chapter"), F.lit("done").alias("state")).unionByName(failed.select("chapter", F.concat("reason", F.col("attempts").cast("string")).alias("state")))


def appended_log(spark, d):
    path = shared.fresh_path(spark, "log")
    rows = s.chunk_log(spark, d).select("stem", "chunk_index", "seq", "status")
    for k in range(2):
        tables.append_log(rows.filter(F.col("seq") % 2 == k), path)
    return logs.latest_wins(spark.read.parquet(path), ["stem", "chunk_index"], F.col("seq")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def split_files(spark, d):
    """Manifests of splits as folders, guarded, summed up, and lines as JSON of each split."""
    root = shared.fresh_path(spark, "splits")
    rows = splits.assigned(s.manifest(spark, d), "speaker_id", "duration_sec").select("utterance_id", "speaker_id", "duration_sec", "split")
    told = tables.write_splits(rows, f"{root}/csv")
    tables.write_jsonl(rows.filter("split <> 'validation'"), f"{root}/json", "split", manifests.SPLITS)
    lines = spark.read.schema("utterance_id string, split string").json(f"{root}/json").groupBy("split").agg(F.count(F.lit(1)).alias("lines"))
    return told.join(lines, "split", "left").select("split", "utterances", F.coalesce("lines", F.lit(0)).alias("lines"))


def checked_manifest(spark, d):
    """A manifest that breaks no rule, written by key and read back."""
    path = shared.fresh_path(spark, "manifest")
    rows = s.manifest(spark, d)
    good = rows.join(manifests.violations(rows).select("utterance_id").distinct(), "utterance_id", "left_anti")
    tables.write_manifest(good.select(*[F.col(c).cast("string") for c in manifests.COLUMNS]), path)
    return tables.read_csv(spark, path, manifests.COLUMNS).select("utterance_id", "speaker_id", "transcript_status")


def evaluation_report(spark, d):
    told = reports.evaluation_report("run", scoring.gold_scores(spark, d), "2020-01-01")
    return spark.createDataFrame([(k, line) for k, line in enumerate(told.splitlines())], "line long, text string")


def comparison_report(spark, d):
    a, b = scoring.two_runs(spark, d)
    differences, label = evaluation.comparison(a, b)
    told = reports.comparison_report("one", "two", differences, label, a[1].count())
    return spark.createDataFrame([(k, line) for k, line in enumerate(told.splitlines())], "line long, text string")


def streamed_chunks(spark, d):
    """The chunk log as a stream of files: the latest row of each chunk, those that went well."""
    root = shared.fresh_path(spark, "stream")
    source = s.table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts")
    source.repartition(4, "event_id").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    log = stream.select(F.concat(F.lit("c"), F.coalesce(F.col("user_id").cast("string"), F.lit(""))).alias("stem"), F.pmod(F.floor("value"), F.lit(8)).cast("long").alias("chunk_index"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))
    chunk_log.merged(log, ["stem", "chunk_index"], "seq", f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return chunk_log.current(spark.read.parquet(f"{root}/out").drop("batch"), ["stem", "chunk_index"], "seq", F.col("status") == "ok")


def windowed_chunks(spark, d):
    """Counts by day and status, here over the table as a batch."""
    return chunk_log.windowed_counts(s.chunk_log(spark, d), "ts", F.col("status"))


QUERIES = {
    f.__name__: f
    for f in (
        latest_ok_events, latest_ok_chunks, users_with_any_ok, last_event_at_first_place, orders_to_do, failed_again, metadata_updates, reused_chunks, finished_recordings, all_chapters, chapter_ids, chosen_chapters,
        media_kinds, best_resources, mp3_checks, download_outcomes, download_states, download_totals, chapter_records, relative_paths, session_sheet, stripped_texts, collapsed_texts, names_checked, parsed_numbers,
        rounded_values, class_suffixes, ramps, signal_levels, signal_quality, signal_clips, planned_chunks, chunked_predictions, stitched_turns, unit_groups, aligned_tokens, greedy_symbols, chapter_segments, page_units,
        wav_round_trip, wav_clips, csv_round_trip, metadata_or_listing, chunk_folder, state_files, appended_log, split_files, checked_manifest, evaluation_report, comparison_report, streamed_chunks, windowed_chunks,
    )
}

BOOKS = ", ".join(f"({k}, '{b}', {n})" for k, (b, n) in enumerate(chapters.BOOKS.items()))
EVERY = f"chapters as (select k * 1000 + n as position, book, n as chapter, book || '.' || n || '.{CODE}' as chapter_id, book || printf('_%03d.mp3', n) as filename from (select k, book, unnest(range(1, total + 1))::int as n from (values {BOOKS}) b(k, book, total)))"
LATEST = f"with {s.CHUNK_LOG}, last as (select stem, chunk_index, max(seq) as seq, arg_max(status, seq) as status, arg_max(prediction, seq) as prediction from chunk_log group by 1, 2)"
ATTEMPTS = "tries as (select user_id % 300 as chapter, event_id % 4 as attempt, arg_max(coalesce(nullif(event_type, 'purchase'), '-'), event_id) as e from events where user_id is not null and event_id % 4 > 0 group by 1, 2), found as (select chapter, min(case when e = '-' then attempt end) as ok, max(attempt) as n, arg_max(nullif(e, '-'), attempt) as r from tries group by 1), outcomes as (select chapter, case when ok is not null then 'downloaded' when n >= 3 then 'failed' else 'to retry' end as result, coalesce(ok, n) as attempts, case when ok is null then r end as reason from found)"
BEST = "best as (select vec_id, list_transform(range(0, 8), lambda i: list_position(embedding[i * 8 + 1 : i * 8 + 8], list_max(embedding[i * 8 + 1 : i * 8 + 8])) - 1) as b from embeddings where embedding is not null)"
GROUPS = f"""with recursive {s.UNITS}, u as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as i, "start" as a, "end" as b from units),
 walk(conv_id, i, f, fa) as (select conv_id, i, i, a from u where i = 0 union all select u.conv_id, u.i, case when u.b - w.fa > {s.LONGEST} then u.i else w.f end, case when u.b - w.fa > {s.LONGEST} then u.a else w.fa end from walk w join u on u.conv_id = w.conv_id and u.i = w.i + 1),
 g as (select conv_id, f, max(i) as l from walk group by 1, 2), n as (select conv_id, max(i) as top from u group by 1)"""
QUALITY = "case when clip > 0.001 or power = 0 or 20 * log10(sqrt(power)) < -40 then 'poor' when 20 * log10(sqrt(power)) < -30 then 'fair' else 'good' end"
CUT = f"floor(case when vec_id % 3 > 0 then 0.05 else 0 end * {int(s.FRAME / 0.025)})::int + 1 : case when vec_id % 4 > 0 then floor(0.15 * {int(s.FRAME / 0.025)})::int else 64 end"
SIX = scoring.six

ORACLE_SQL = {
    "latest_ok_events": "select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1 and event_type <> 'error'",
    "latest_ok_chunks": f"{LATEST} select stem, chunk_index, seq, status from last where status = 'ok'",
    "users_with_any_ok": "select distinct user_id from events where event_type = 'purchase'",
    "last_event_at_first_place": "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, min(event_id) as place from events where user_id is not null group by user_id",
    "orders_to_do": "select o_orderkey, o_orderstatus from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'F')",
    "failed_again": "select c_custkey, c_name from customer where c_custkey in (select user_id from events where event_type = 'error')",
    "metadata_updates": "select o_orderkey, case when o_orderkey % 5 = 0 then 'N' else o_orderstatus end as o_orderstatus, case when o_orderkey % 5 = 0 then o_orderkey + (select max(o_orderkey) from orders) else o_orderkey end as seq from orders",
    "reused_chunks": f"{LATEST}, plan as (select distinct stem, unnest(range(0, 9)) as chunk_index from chunk_log) select p.stem, p.chunk_index, l.prediction, l.stem is not null as reused from plan p left join (select * from last where status = 'ok') l on p.stem = l.stem and p.chunk_index = l.chunk_index",
    "finished_recordings": f"{LATEST}, r as (select stem, count(*) as n, count(*) filter (where status <> 'ok') as bad, string_agg(trim(prediction), ' ' order by chunk_index) as t from last group by 1) select stem, md5(case when bad > 0 then '' else t end) as prediction_md5, case when bad > 0 then 'failed' else 'ok' end as status, case when bad > 0 then printf('%d/%d chunks failed; rerun to retry them', bad, n) else '' end as error_message from r",
    "all_chapters": f"with {EVERY} select position, book, chapter, chapter_id, 'http://x/1/' || chapter_id as url, filename from chapters",
    "chapter_ids": "select o_orderkey, ['JHN.3.XYZ', 'JHN.22.XYZ', 'ABC.1.XYZ', 'JHN.x.XYZ', 'JHN.3', 'REV. 22.XYZ', 'JHN.3.ABC'][o_orderkey % 7 + 1] as id, [null, 'outside the range', 'unknown book', 'invalid chapter number', 'invalid chapter id', null, 'invalid chapter id'][o_orderkey % 7 + 1] as id_error, case o_orderkey % 7 when 0 then 'JHN' when 5 then 'REV' end as book, case o_orderkey % 7 when 0 then '3' when 5 then '22' end as chapter from orders",
    "chosen_chapters": f"with {EVERY} select chapter_id, 'failed' as why from chapters where book = 'MAT' and chapter in (select user_id % 40 from events where event_type = 'error') union all select chapter_id, 'book' from chapters where book in ('JUD', 'JAS')",
    "media_kinds": f"with {s.RESOURCES} select seq, kind from classified",
    "best_resources": f"with {s.RESOURCES}, r as (select *, row_number() over (partition by chapter order by case kind when 'direct-mp3' then 0 else 1 end, seq) as k from classified where kind in ('direct-mp3', 'direct-audio')) select chapter, seq, kind from r where k = 1",
    "mp3_checks": "with c as (select doc_id, strlen(coalesce(text, '')) + [3, 2, 2, 0][doc_id % 4 + 1] as n, coalesce(text, '') as t from documents) select doc_id, case when n <= 1000 then 'file is too small (' || n || ' bytes)' when doc_id % 4 < 2 or (doc_id % 4 = 3 and t[1:3] = 'ID3') then null else 'file does not have an MP3 header' end as error from c",
    "download_outcomes": f"with {ATTEMPTS} select * from outcomes",
    "download_states": f"with {EVERY}, {ATTEMPTS}, st as (select c.chapter_id, case when c.chapter % 3 = 0 and c.chapter % 2 = 1 then 'done' when o.result = 'downloaded' then 'done' when o.result = 'failed' then 'failed' end as state from chapters c left join outcomes o on c.book = 'MAT' and o.chapter = c.chapter) select * from st where state is not null",
    "download_totals": "select count(*) as total, count(*) filter (where event_type = 'purchase') as downloaded, count(*) filter (where event_type = 'view') as skipped, count(*) filter (where event_type = 'error') as failed, count(*) filter (where event_type not in ('purchase', 'view')) as remaining from events",
    "chapter_records": f"with {EVERY} select chapter_id, case when chapter % 2 = 0 then 'audio/' || filename else 'old' end as audio_file from chapters where chapter % 2 = 0 or chapter <= 3",
    "relative_paths": "select o_orderkey, case o_orderkey % 4 when 3 then '/else/' || o_orderkey else 'a/' || o_orderkey end as path from orders",
    "session_sheet": "with i as (select p_partkey, printf('P%06d', p_partkey) as prompt_id, p_size % 2 = 0 as r, p_size % 4 = 0 as w, p_name from part where p_size % 5 in (1, 2, 4)) select row_number() over (order by p_partkey) as \"order\", prompt_id, case when r then 'new ' || p_name else p_name end as show_text, case when r then 'new ' || p_name else '' end as expected_read_text from i where not (r and not w) union all select 0, prompt_id, '', '' from i where r and not w",
    "stripped_texts": f"select doc_id, cast(len(list_filter(string_split(s, ' '), lambda x: x <> '')) as bigint) as n_words, cast(length(replace(s, ' ', '')) as bigint) as n_marks, md5(s) as stripped_md5 from (select doc_id, {s.stripped_sql("coalesce(text, '')")} as s from documents)",
    "collapsed_texts": f"with c as (select doc_id, trim(regexp_replace(coalesce(text, ''), '{s.WS}+', ' ', 'g')) as t from documents) select doc_id, md5(t) as collapsed_md5, t = '' as blank from c",
    "names_checked": "select c_custkey, c_custkey % 5 = 0 and length('a' || c_custkey) >= 2 or c_custkey % 5 = 1 or c_custkey % 5 = 2 as reviewer, c_custkey % 5 = 1 and c_custkey >= 100 or c_custkey % 5 = 2 as speaker from customer",
    "parsed_numbers": "select o_orderkey, case o_orderkey % 6 when 0 then (o_orderkey || '.50')::double when 1 then ('-0.' || o_orderkey)::double when 3 then ('10' || o_orderkey)::double when 4 then (o_orderkey || 'e-2')::double end as value from orders",
    "rounded_values": "select l_orderkey, l_linenumber, cast(format('{:.2f}', l_extendedprice / 7) as double) as two, cast(format('{:.3f}', -l_quantity / 16) as double) as three, cast(format('{:.1f}', l_discount / 8) as double) as one from lineitem",
    "class_suffixes": "select p_partkey, split_part(p_type, ' ', -1) || ';x_y;' || array_to_string(list_filter(string_split(p_brand, ' '), lambda x: x <> ''), ';') as suffixes from part",
    "ramps": f"with v as (select event_id, case when event_id % 11 > 0 then value end as x, coalesce(value, 0.0) as y from events) select event_id, {SIX(ramp_sql('x', 90.0, 10.0))} as ramp, {SIX(plateau_sql('y', (5.0, 20.0, 60.0, 90.0)))} as plateau from v",
    "signal_levels": f"with {s.SIGNALS}, {AUDIO_SQL} select vec_id, {four('silence')} as silence_ratio, {four('clip')} as clip_ratio, {four('rms')} as rms_dbfs from sound",
    "signal_quality": f"with {s.SIGNALS}, l as (select vec_id, {square_sql('samples')} as power, len(list_filter(samples, lambda x: abs(x) >= 0.999::float)) / len(samples) as clip from signals) select vec_id, {QUALITY} as quality from l",
    "signal_clips": f"with {s.SIGNALS}, c as (select vec_id, samples[{CUT}] as cut from signals) select vec_id, len(cut) as n, {four('list_sum(list_transform(cut, lambda x: x::double))')} as sum from c",
    "unit_groups": f"""{GROUPS} select g.conv_id, (row_number() over (partition by g.conv_id order by f) - 1)::int as place, f as first, l as last, {SIX('case when f = 0 then x.a else (p.b + x.a) / 2 end')} as "start", {SIX('case when l = n.top then y.b else (y.b + z.a) / 2 end')} as "end"
 from g join n on g.conv_id = n.conv_id join u x on x.conv_id = g.conv_id and x.i = f join u y on y.conv_id = g.conv_id and y.i = l left join u p on p.conv_id = g.conv_id and p.i = f - 1 left join u z on z.conv_id = g.conv_id and z.i = l + 1""",
    "greedy_symbols": f"with {BEST} select vec_id, array_to_string(list_transform(list_filter(range(1, 9), lambda i: b[i] <> {s.BLANK} and (i = 1 or b[i] <> b[i - 1])), lambda i: b[i]), ',') as ids from best",
    "wav_round_trip": "select vec_id, case when vec_id % 13 > 0 then 16000 else 0 end as rate, case when vec_id % 13 > 0 then 64 else 0 end::bigint as n, case when vec_id % 13 > 0 then 0.004 else 0.0 end::double as duration_sec, vec_id % 13 > 0 as valid, case when vec_id % 13 > 0 then 'valid audio, 0.00s' else 'file does not exist' end as reason from embeddings where embedding is not null",
    "wav_clips": f"select 'g' || vec_id as segment_id, 44 + 2 * case when vec_id % 2 = 0 then {int(0.1 * int(s.FRAME / 0.025)) - int(0.05 * int(s.FRAME / 0.025))} else {64 - int(0.05 * int(s.FRAME / 0.025))} end::bigint as n_bytes, case when vec_id % 2 = 0 then {int(0.1 * int(s.FRAME / 0.025)) - int(0.05 * int(s.FRAME / 0.025))} else {64 - int(0.05 * int(s.FRAME / 0.025))} end / {int(s.FRAME / 0.025)}::double as duration_sec from embeddings where embedding is not null",
    "csv_round_trip": f"with {s.PREDICTIONS} select audio_path, md5('say \"' || reference || '\",' || chr(10) || 'then') as reference_md5, '' as error_message, status from predictions",
    "metadata_or_listing": "select '.txt' as kind, '' as reference_text, '' as speaker_id",
    "chunk_folder": f"with {s.CHUNK_LOG} select status, coalesce(chunk_index::varchar, '') as chunk_index, count(*) as n, count(*) as named from chunk_log group by 1, 2",
    "state_files": "select * from (values ('a', 'done'), ('b', 'done'), ('c', 'r3')) t(chapter, state)",
    "appended_log": f"{LATEST} select status, count(*) as n from last group by 1",
    "split_files": f"with {s.MANIFEST}, {SPLIT}, a as (select m.speaker_id, coalesce(s.split, 'train') as split from manifest m left join splits s on m.speaker_id = s.speaker_id) select d.split, count(a.split) as utterances, case when d.split = 'validation' then 0 else count(a.split) end as lines from (values ('train'), ('validation'), ('test')) d(split) left join a on a.split = d.split group by 1",
    "checked_manifest": f"with {s.MANIFEST} select utterance_id, speaker_id, transcript_status from manifest where domain in ('general', 'scripture', 'agriculture') and regexp_full_match(speaker_id, 'VH_S[0-9]{{3,}}|unknown') and not (transcript_status = 'not_available' and trim(transcript) <> '') and not (transcript_status = 'verified' and trim(transcript) = '') and not (source = 'native_recording' and consent_status <> 'given')",
    "streamed_chunks": f"{LATEST} select stem, chunk_index, seq, status from last where status = 'ok'",
    "windowed_chunks": f"with {s.CHUNK_LOG} select date_trunc('day', ts) as window_start, status, count(*) as n from chunk_log group by 1, 2",
}

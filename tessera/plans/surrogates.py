"""The corpus's tables, derived from the given ones by rules on columns alone; each as a DataFrame and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text

#: Letters that texts have beyond ASCII, and ASCII marks in their place: marks are no part of stripped texts, so that DuckDB's edit distance, by bytes, counts letters.
ACCENTS, MARKS = "àáâäçèéêëíîñóôöúüßÉÈÊÇÑÓÍÄÖÜ", "!#$%&()*+,-./:;<=>?@[]^_`{|}"
WORDS, FRAME, BLANK, LONGEST = 40, 8, 7, 60.0

WS = r"[\s\x1c-\x1f\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stripped_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '[\p{{P}}\p{{S}}]', ' ', 'g'), '{WS}+', ' ', 'g'))"


def words_sql(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def letters_sql(x: str) -> str:
    return f"translate({x}, '{ACCENTS}', '{MARKS}')"


def counts_sql(ref: str, hyp: str) -> str:
    """(c: distance, d: deletions) of two lists of words, as a fold over the one and, inside, the other; a deletion goes before an insertion, and that before the diagonal."""
    start = f"list_transform(range(0, len({hyp}) + 1), lambda n: {{'c': n, 'd': 0::bigint}})"
    cost = f"least(acc[h + 1].c + 1, r[-1].c + 1, acc[h].c + case when {hyp}[h] = x then 0 else 1 end)"
    cell = f"{{'c': {cost}, 'd': case when acc[h + 1].c + 1 = {cost} then acc[h + 1].d + 1 when r[-1].c + 1 = {cost} then r[-1].d else acc[h].d end}}"
    inner = f"list_reduce(range(1, len({hyp}) + 1), lambda r, h: r || [{cell}], [{{'c': acc[1].c + 1, 'd': acc[1].d + 1}}])"
    return f"list_reduce({ref}, lambda acc, x: {inner}, {start})[-1]"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with reference and hypothesis: the first WORDS words, and the same without every 7th, with every 5th reversed and `uh` after every 11th."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    w = F.slice(text.words(F.coalesce("text", F.lit(""))), 1, WORDS)

    def changed(x, i):
        place = i + 1
        own = F.when(place % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.when(place % 5 == 0, F.reverse(x)).otherwise(x)))
        return F.concat(own, F.when(place % 11 == 0, F.array(F.lit("uh"))).otherwise(F.array().cast("array<string>")))

    found = docs.withColumn("w", w).drop("text")
    return found.select("doc_id", "lang", "source", "n_chars", F.array_join("w", " ").alias("reference"), F.array_join(F.flatten(F.transform("w", changed)), " ").alias("hypothesis"))


PAIRS = f"""words as (select doc_id, lang, source, n_chars, {words_sql("coalesce(text, '')")}[1:{WORDS}] as w from documents),
 pairs as (select doc_id, lang, source, n_chars, array_to_string(w, ' ') as reference, coalesce(array_to_string(flatten(list_transform(w, lambda x, i: case when i % 7 = 0 then [] else [case when i % 5 = 0 then reverse(x) else x end] end || case when i % 11 = 0 then ['uh'] else [] end)), ' '), '') as hypothesis from words)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """predictions of all documents; every 17th failed."""
    return pairs(spark, sf_dir).select(
        F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("audio_path"),
        "reference",
        F.col("hypothesis").alias("prediction"),
        (F.col("n_chars") / 9.0).alias("duration_sec"),
        F.when(F.col("doc_id") % 17 == 0, "failed").otherwise("ok").alias("status"),
        F.col("doc_id").alias("seq"),
        "lang",
        "source",
    )


PREDICTIONS = f"{PAIRS}, predictions as (select 'd/' || doc_id as audio_path, reference, hypothesis as prediction, n_chars / 9.0::double as duration_sec, case when doc_id % 17 = 0 then 'failed' else 'ok' end as status, doc_id as seq, lang, source from pairs)"


def gold_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation set: labelled documents, with the speaker from the source; some stand twice, the last one counts."""
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    rows = pairs(spark, sf_dir).join(labels, "doc_id", "left_semi")
    base = rows.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("audio_path"), "reference", F.col("source").alias("speaker_id"), F.format_string("s%08d", "doc_id").alias("segment_id"), (F.col("n_chars") / 9.0).alias("duration_sec"), F.col("doc_id").alias("seq"))
    first = base.filter("seq % 5 = 0").select("audio_path", F.lit("other words").alias("reference_text"), F.lit("nobody").alias("speaker_id"), "segment_id", "duration_sec", (F.col("seq") - 10_000_000).alias("seq"))
    return base.withColumnRenamed("reference", "reference_text").unionByName(first)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments in review: documents with labels; quality 1 is verified, 0 is rejected, the others are pending."""
    labels = table(spark, sf_dir, "labels").filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = pairs(spark, sf_dir).join(labels, "doc_id", "left")
    odd = F.col("doc_id") % 3 == 0
    good = F.col("quality") == 1
    return rows.select(
        F.format_string("s%08d", "doc_id").alias("segment_id"),
        F.concat(F.lit("audio/"), "source", F.lit(".wav")).alias("audio_path"),
        F.lit("unknown").alias("speaker_id"),
        F.col("source").alias("source_chapter"),
        F.when(F.col("doc_id") % 29 != 0, F.lit(0.0)).alias("start_sec"),
        F.when(F.col("doc_id") % 31 != 0, F.char_length("reference") / 9.0).alias("end_sec"),
        (-(F.col("doc_id") % 250) / 100.0).alias("align_score"),
        F.col("reference").alias("candidate_text"),
        F.col("hypothesis").alias("raw_asr"),
        F.when(good, F.when(odd, "needs_correction").otherwise("correct")).when(F.col("quality") == 0, "rejected").otherwise("").alias("decision"),
        F.when(good & odd, F.col("hypothesis")).otherwise("").alias("corrected_text"),
        F.when(F.col("quality").isNotNull() & (F.col("doc_id") % 23 != 0), "rv1").otherwise("").alias("reviewer"),
        F.when(good, "verified").when(F.col("quality") == 0, "rejected").otherwise("pending_review").alias("review_status"),
        F.when(F.col("doc_id") % 5 == 0, "HIGH_CONFIDENCE_CANDIDATE").when(F.col("doc_id") % 5 == 1, "REJECT_CANDIDATE").when(F.col("doc_id") % 5 == 2, "").otherwise("NEEDS_REVIEW").alias("triage_status"),
        F.when(F.col("doc_id") % 13 == 0, "none").otherwise((F.col("doc_id") % 101 / 100.0).cast("string")).alias("confidence_score"),
        (F.col("doc_id") % 3 == 0).cast("int").alias("n_headings"),
        F.col("doc_id").alias("seq"),
    )


GOLD = f"""{PAIRS}, quality as (select doc_id, max(quality) as quality from labels where doc_id is not null group by 1),
 gold as (select printf('s%08d', p.doc_id) as segment_id, 'audio/' || source || '.wav' as audio_path, 'unknown' as speaker_id, source as source_chapter,
 case when p.doc_id % 29 <> 0 then 0.0::double end as start_sec, case when p.doc_id % 31 <> 0 then length(reference) / 9.0::double end as end_sec, -(p.doc_id % 250) / 100.0::double as align_score,
 reference as candidate_text, hypothesis as raw_asr,
 case when quality = 1 then case when p.doc_id % 3 = 0 then 'needs_correction' else 'correct' end when quality = 0 then 'rejected' else '' end as decision,
 case when quality = 1 and p.doc_id % 3 = 0 then hypothesis else '' end as corrected_text, case when quality is not null and p.doc_id % 23 <> 0 then 'rv1' else '' end as reviewer,
 case when quality = 1 then 'verified' when quality = 0 then 'rejected' else 'pending_review' end as review_status,
 case p.doc_id % 5 when 0 then 'HIGH_CONFIDENCE_CANDIDATE' when 1 then 'REJECT_CANDIDATE' when 2 then '' else 'NEEDS_REVIEW' end as triage_status,
 case when p.doc_id % 13 = 0 then null else (p.doc_id % 101) / 100.0::double end as confidence, (p.doc_id % 3 = 0)::int as n_headings, p.doc_id as seq
 from pairs p left join quality q on p.doc_id = q.doc_id)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances: orders; every tenth customer's speaker is unknown."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("u"), F.lpad(key.cast("string"), 9, "0")).alias("utterance_id"),
        F.concat(F.lit("a/"), key.cast("string"), F.lit(".wav")).alias("audio_path"),
        F.when(F.col("o_custkey") % 10 == 0, "unknown").when(F.col("o_custkey") % 97 == 0, "someone").otherwise(F.concat(F.lit("VH_S"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"))).alias("speaker_id"),
        F.lit("unknown").alias("district"),
        F.lit("").alias("age_group"),
        F.lit("").alias("gender"),
        F.when(key % 19 == 0, F.lit(0).cast("decimal(18,3)")).otherwise((F.col("o_totalprice") / 1000).cast("decimal(18,3)")).alias("duration_sec"),
        F.lit("mr").alias("language"),
        F.lit("d").alias("dialect"),
        F.when(F.col("o_orderpriority").startswith("1"), "general").when(F.col("o_orderpriority").startswith("2"), "agriculture").when(F.col("o_orderpriority").startswith("5"), "low").otherwise("scripture").alias("domain"),
        F.when(key % 7 == 0, "words").otherwise(" ").alias("transcript"),
        F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "O", "not_available").otherwise("pending_review").alias("transcript_status"),
        F.lit("unchecked").alias("recording_quality"),
        F.when(key % 11 == 0, "not_applicable_published").otherwise("given").alias("consent_status"),
        F.when(key % 2 == 0, "native_recording").otherwise("published").alias("source"),
        F.lit("l").alias("license"),
        F.when(key % 3 == 0, "train").when(key % 3 == 1, "validation").otherwise("unassigned").alias("split"),
    )


MANIFEST = """manifest as (select 'u' || lpad(o_orderkey::varchar, 9, '0') as utterance_id, case when o_custkey % 10 = 0 then 'unknown' when o_custkey % 97 = 0 then 'someone' else 'VH_S' || lpad(o_custkey::varchar, 6, '0') end as speaker_id,
 case when o_orderkey % 19 = 0 then 0::decimal(18,3) else (o_totalprice / 1000)::decimal(18,3) end as duration_sec,
 case when o_orderpriority[1] = '1' then 'general' when o_orderpriority[1] = '2' then 'agriculture' when o_orderpriority[1] = '5' then 'low' else 'scripture' end as domain,
 case when o_orderkey % 7 = 0 then 'words' else ' ' end as transcript, case o_orderstatus when 'F' then 'verified' when 'O' then 'not_available' else 'pending_review' end as transcript_status,
 case when o_orderkey % 11 = 0 then 'not_applicable_published' else 'given' end as consent_status, case when o_orderkey % 2 = 0 then 'native_recording' else 'published' end as source,
 case o_orderkey % 3 when 0 then 'train' when 1 then 'validation' else 'unassigned' end as split from orders)"""


def chunk_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of chunks: events; errors are failures."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), F.coalesce(F.col("user_id").cast("string"), F.lit(""))).alias("stem"),
        F.pmod(F.floor("value"), F.lit(8)).cast("long").alias("chunk_index"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit(" "), "event_type", F.lit(" "), F.col("event_id").cast("string")).alias("prediction"),
        F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"),
        F.col("ts"),
    )


CHUNK_LOG = "chunk_log as (select 'c' || coalesce(user_id::varchar, '') as stem, ((floor(value)::bigint % 8) + 8) % 8 as chunk_index, event_id as seq, ' ' || event_type || ' ' || event_id as prediction, case when event_type = 'error' then 'failed' else 'ok' end as status, ts from events)"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of 64 samples at a rate at which a frame is FRAME samples; every 9th is loud and clipped, every 7th is silent at first."""
    rows = table(spark, sf_dir, "embeddings").filter("embedding is not null")
    loud = F.transform("embedding", lambda x: F.greatest(F.least(x * 9, F.lit(1.0).cast("float")), F.lit(-1.0).cast("float")).cast("float"))
    late = F.transform("embedding", lambda x, i: F.when(i < 40, F.lit(0.0).cast("float")).otherwise(x))
    return rows.select("vec_id", F.when(F.col("vec_id") % 9 == 0, loud).when(F.col("vec_id") % 7 == 0, late).otherwise(F.col("embedding")).alias("samples"), F.lit(int(FRAME / 0.025)).alias("rate"), "label")


SIGNALS = "signals as (select vec_id, list_transform(embedding, lambda x, i: case when vec_id % 9 = 0 then greatest(least(x * 9::float, 1::float), -1::float) when vec_id % 7 = 0 and i <= 40 then 0::float else x end) as samples, label from embeddings where embedding is not null)"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the turns of conversations, one after the other, with gaps."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("sum", F.sum("n").over(upto)).select("conv_id", "turn", ((F.col("sum") - F.col("n")) / 16 + F.col("turn") * 0.5).alias("start"), (F.col("sum") / 16 + F.col("turn") * 0.5).alias("end"))


UNITS = "sums as (select conv_id, turn, length(coalesce(text, ''))::bigint as n, sum(length(coalesce(text, ''))::bigint) over (partition by conv_id order by turn rows unbounded preceding)::bigint as s from conversations), units as (select conv_id, turn, (s - n) / 16.0::double + turn * 0.5::double as \"start\", s / 16.0::double + turn * 0.5::double as \"end\" from sums)"


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a candidate, the next one as the other text; one pass with a window over a conversation."""
    turns = table(spark, sf_dir, "conversations")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    follows = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")) == F.col("turn") + 1
    return turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("candidate"), F.coalesce(F.when(follows, after), F.lit("")).alias("asr"))


TURNS = "turns as (select a.conv_id, a.turn, a.role, coalesce(a.text, '') as candidate, coalesce(b.text, '') as asr from conversations a left join conversations b on a.conv_id = b.conv_id and a.turn + 1 = b.turn)"


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media resources: pages, with content types and endings by their ids."""
    n = F.col("page_id")
    kind = F.when(n % 5 == 0, "Audio/MPEG; q=1").when(n % 5 == 1, "text/html").when(n % 5 == 2, "application/x-mpegURL").when(n % 5 == 3, "audio/ogg").otherwise("")
    ending = F.when(n % 7 == 0, "/a.mp3?x=1").when(n % 7 == 1, "/a.m3u8").when(n % 7 == 2, "/a?f=.mp3").when(n % 7 == 3, "/a.MPD").otherwise("")
    return table(spark, sf_dir, "pages").select((n % 40).alias("chapter"), n.alias("seq"), F.concat("url", ending).alias("url"), kind.alias("content_type"))


RESOURCES = r"""resources as (select page_id % 40 as chapter, page_id as seq, url || case page_id % 7 when 0 then '/a.mp3?x=1' when 1 then '/a.m3u8' when 2 then '/a?f=.mp3' when 3 then '/a.MPD' else '' end as url,
 case page_id % 5 when 0 then 'Audio/MPEG; q=1' when 1 then 'text/html' when 2 then 'application/x-mpegURL' when 3 then 'audio/ogg' else '' end as content_type from pages),
 kinds as (select *, lower(url) as u, lower(split_part(content_type, ';', 1)) as t, split_part(split_part(lower(url), '?', 1), '#', 1) as p from resources),
 classified as (select chapter, seq, url, case when t in ('audio/mpeg', 'audio/mp3', 'audio/mpeg3') or p like '%.mp3' then 'direct-mp3' when t in ('application/dash+xml', 'application/vnd.apple.mpegurl', 'application/x-mpegurl') or u like '%.m3u8' or u like '%.mpd' then 'stream-manifest' when t like 'audio/%' then 'direct-audio' else 'other' end as kind from kinds)"""

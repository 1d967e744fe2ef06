"""Chapters of a collection: the generated dimension, ids, choice and state of downloads, media resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import logs

#: The books with their numbers of chapters and the total; the least bytes of a file, the tries of a download.
BOOKS = {
    "MAT": 28, "MRK": 16, "LUK": 24, "JHN": 21, "ACT": 28, "ROM": 16, "1CO": 16, "2CO": 13, "GAL": 6, "EPH": 6, "PHP": 4, "COL": 4, "1TH": 5, "2TH": 3,
    "1TI": 6, "2TI": 4, "TIT": 3, "PHM": 1, "HEB": 13, "JAS": 5, "1PE": 5, "2PE": 3, "1JN": 5, "2JN": 1, "3JN": 1, "JUD": 1, "REV": 22,
}
TOTAL, LEAST_BYTES, ATTEMPTS = 260, 10_000, 3
ID = "chapter_id"


def all_chapters(spark: SparkSession, code: str, base_url: str = "", books: dict[str, int] = BOOKS, total: int | None = None) -> DataFrame:
    """(position, book, chapter, chapter_id, url, filename) of every chapter, in order; a wrong total is an error."""
    total = TOTAL if total is None and books is BOOKS else total
    if total is not None and sum(books.values()) != total:
        raise ValueError(f"{total} chapters expected, {sum(books.values())} listed")
    listed = spark.createDataFrame([(k, b, n) for k, (b, n) in enumerate(books.items())], "book_position int, book string, n int")
    one = listed.select("book_position", "book", F.explode(F.sequence(F.lit(1), "n")).alias("chapter"))
    key = F.concat_ws(".", "book", F.col("chapter").cast("string"), F.lit(code))
    return one.select(
        (F.col("book_position") * 1000 + F.col("chapter")).alias("position"),
        "book",
        "chapter",
        key.alias(ID),
        F.concat(F.lit(f"{base_url}/"), key).alias("url"),
        F.concat("book", F.format_string("_%03d.mp3", "chapter")).alias("filename"),
    )


def parsed_ids(rows: DataFrame, column: str, code: str, books: dict[str, int] = BOOKS) -> DataFrame:
    """rows with book, chapter and id_error (null for a valid id BOOK.N.CODE)."""
    parts = F.split(F.col(column), r"\.", -1)
    known = F.create_map([F.lit(x) for kv in books.items() for x in kv])
    three = (F.size(parts) == 3) & (F.try_element_at(parts, F.lit(3)) == code)
    book, n = F.try_element_at(parts, F.lit(1)), text.stripped(F.try_element_at(parts, F.lit(2)))
    whole = F.when(n.rlike(r"^[+-]?[0-9]+(_[0-9]+)*\z"), F.replace(n, F.lit("_"), F.lit("")).try_cast("int"))
    error = F.when(~F.coalesce(three, F.lit(False)), "invalid chapter id").when(known[book].isNull(), "unknown book").when(whole.isNull(), "invalid chapter number").when(~whole.between(1, known[book]), "outside the range")
    ok = error.isNull()
    return rows.withColumns({"id_error": error, "book": F.when(ok, book), "chapter": F.when(ok, whole)})


def chosen(chapters: DataFrame, book: str | None = None, chapter_id: str | None = None, failed: DataFrame | None = None) -> DataFrame:
    """All chapters, those of a book, one, or those that failed; at most one of these may be asked for."""
    if sum(x is not None for x in (book, chapter_id, failed)) > 1:
        raise ValueError("book, chapter and failed exclude each other")
    if failed is not None:
        return logs.retried(chapters, failed.select(F.col("chapter").alias(ID)), ID)
    if book is not None:
        return chapters.filter(F.col("book") == book)
    return chapters if chapter_id is None else chapters.filter(F.col(ID) == chapter_id)


def classified(resources: DataFrame) -> DataFrame:
    """resources(url, content_type) with kind."""
    return resources.withColumn("kind", text.media_kind(F.col("url"), F.col("content_type")))


def best_resource(resources: DataFrame, by: str, seq: str) -> DataFrame:
    """The first direct MP3 of each group, or else its first direct audio; groups without either are left out."""
    rank = F.when(F.col("kind") == "direct-mp3", 0).when(F.col("kind") == "direct-audio", 1)
    rest = [c for c in resources.columns if c != by]
    found = resources.withColumn("_rank", rank).filter("_rank is not null").groupBy(by).agg(F.min_by(F.struct(*rest), F.struct("_rank", seq)).alias("_best"))
    return found.select(by, *[F.col("_best")[c].alias(c) for c in rest])


def mp3_error(content: Column, length: Column, least: int = LEAST_BYTES) -> Column:
    """Why bytes are no MP3 file; null if they are one: over `least` bytes, and ID3 or a frame's eleven set bits first."""
    head = F.hex(F.substring(content, 1, 3))
    frame = F.conv(F.substring(head, 3, 2), 16, 10).cast("int").bitwiseAND(0xE0) == 0xE0
    ok = (head == "494433") | (F.substring(head, 1, 2).eqNullSafe(F.lit("FF")) & F.coalesce(frame, F.lit(False)))
    return F.when(length.isNull(), "file does not exist").when(length <= least, F.concat(F.lit("file is too small ("), length.cast("string"), F.lit(" bytes)"))).when(~F.coalesce(ok, F.lit(False)), "file does not have an MP3 header")


def outcomes(attempts: DataFrame) -> DataFrame:
    """(chapter, result, attempts, reason) of attempts(chapter, attempt, error): downloaded at the first try without an error, failed after ATTEMPTS."""
    tried = attempts.filter(F.col("attempt") <= ATTEMPTS)
    first = F.min(F.when(F.col("error").isNull(), F.col("attempt")))
    found = tried.groupBy("chapter").agg(first.alias("_ok"), F.max("attempt").alias("_tries"), F.max_by("error", "attempt").alias("_reason"))
    ok = F.col("_ok").isNotNull()
    result = F.when(ok, "downloaded").when(F.col("_tries") >= ATTEMPTS, "failed").otherwise("to retry")
    return found.select("chapter", result.alias("result"), F.coalesce("_ok", "_tries").alias("attempts"), F.when(~ok, F.col("_reason")).alias("reason"))


def download_state(chapters: DataFrame, files: DataFrame, found: DataFrame, completed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(completed, failed) after a run. files(filename, error): null where a file is valid; found: outcomes; completed(chapter_id).

    A valid file completes its chapter, whatever the state said; an invalid one doesn't.
    """
    there = chapters.join(files.select("filename", F.col("error").alias("_error"), F.lit(True).alias("_there")), "filename", "left")
    there = there.join(completed.select(ID, F.lit(True).alias("_done")).distinct(), ID, "left").join(found.withColumnRenamed("chapter", ID).select(ID, "result", "reason", "attempts"), ID, "left")
    skipped = F.col("_there") & F.col("_error").isNull()
    status = F.when(skipped, "skipped").otherwise(F.coalesce("result", F.lit("remaining")))
    states = there.withColumn("state", status)
    done = states.filter(F.col("state").isin("skipped", "downloaded")).select(ID)
    failed = states.filter("state = 'failed'").select(F.col(ID).alias("chapter"), "reason", "attempts")
    return done, failed


def download_summary(states: DataFrame) -> DataFrame:
    """(total, downloaded, skipped, failed, remaining) of states(state), in one row."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in ("downloaded", "skipped", "failed")]
    return states.agg(F.count(F.lit(1)).alias("total"), *counts).withColumn("remaining", F.expr("total - downloaded - skipped"))


def recorded(metadata: DataFrame, chapters: DataFrame, seq: str) -> DataFrame:
    """metadata(chapter_id, book, chapter, url, audio_file, seq) with chapters' entries new or moved to the end."""
    new = chapters.select(ID, "book", "chapter", "url", F.concat(F.lit("audio/"), "filename").alias("audio_file"), F.col("position").cast("long").alias(seq))
    return logs.moved_to_end(metadata, new, ID, seq)

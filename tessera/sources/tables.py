"""Readers and writers of the corpus's files: CSV, JSON and JSON lines, with explicit schemas. Missing text is empty text, as on disk."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.operators import gold, logs, manifests

#: The columns of the files.
PREDICTIONS = ("audio_path", "reference", "prediction", "duration_sec", "inference_time_sec", "status", "error_message")
METADATA = ("audio_path", "reference_text", "speaker_id")
CHUNKS = ("chunk_index", "start_sec", "end_sec", "prediction", "status", "error_message")
SPLITS = manifests.SPLITS


def text_schema(columns: tuple[str, ...]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def hadoop_path(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    made, files = hadoop_path(spark, path)
    return bool(files.globStatus(made))


def header_of(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("enforceSchema", "false").csv(path)
    return first.columns


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """The columns of a CSV file with a header, by name, all as texts; a column that the file lacks is empty. Quoted fields may hold lines and doubled quotes."""
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("inferSchema", "false").csv(path)
    return raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in columns])


def read_or_empty(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """As read_csv; no rows where there is no file."""
    return read_csv(spark, path, columns) if exists(spark, path) else spark.createDataFrame([], text_schema(columns))


def read_folder(spark: SparkSession, pattern: str, columns: tuple[str, ...]) -> DataFrame:
    """Many CSV files as one table with stem (the file's name) and seq, in the order of the files and their lines."""
    raw = spark.read.schema(text_schema(columns)).option("header", "true").option("escape", '"').csv(pattern)
    named = raw.withColumns({"stem": F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:\.[^./]*)?$", 1), "seq": F.monotonically_increasing_id()})
    return named.withColumns({c: F.coalesce(c, F.lit("")) for c in columns})


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, METADATA)


def samples(spark: SparkSession, metadata_path: str, audio_pattern: str) -> DataFrame:
    """The metadata's rows; where it has none, the audio files by path, without references."""
    told = read_metadata(spark, metadata_path)
    if not told.isEmpty():
        return told
    return audio_listing(spark, audio_pattern).select(F.col("path").alias("audio_path"), F.lit("").alias("reference_text"), F.lit("").alias("speaker_id"))


def audio_listing(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, stem) of files; their content isn't read. No files, no rows."""
    if not exists(spark, pattern):
        return spark.createDataFrame([], "path string, length long, stem string")
    found = spark.read.format("binaryFile").load(pattern).select("path", "length")
    return found.withColumn("stem", F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1))


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of settings or state; None where there is none."""
    if not exists(spark, path):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def read_json(spark: SparkSession, path: str, default: Any) -> Any:
    """A small JSON file; the default where it is missing or broken."""
    try:
        raw = read_text(spark, path)
        return default if raw is None else json.loads(raw)
    except ValueError:
        return default


def read_completed(spark: SparkSession, path: str) -> DataFrame:
    """(chapter_id) of {"completed": [...]}, each once; empty for another shape."""
    found = read_json(spark, path, {})
    ids = found.get("completed", []) if isinstance(found, dict) else []
    return spark.createDataFrame([(str(i),) for i in sorted(set(ids))] if isinstance(ids, list) else [], "chapter_id string")


def read_failed(spark: SparkSession, path: str) -> DataFrame:
    """(chapter, reason, attempts, seq) of {"failed": [...]}; empty for another shape."""
    found = read_json(spark, path, {})
    rows = found.get("failed") if isinstance(found, dict) else None
    rows = [r for r in rows if isinstance(r, dict)] if isinstance(rows, list) else []
    return spark.createDataFrame([(r.get("chapter"), r.get("reason"), r.get("attempts"), k) for k, r in enumerate(rows)], "chapter string, reason string, attempts int, seq long")


def read_chapter_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(chapter_id, book, chapter, url, audio_file, seq) of a JSON array; empty for another shape."""
    rows = read_json(spark, path, [])
    rows = [r for r in rows if isinstance(r, dict)] if isinstance(rows, list) else []
    return spark.createDataFrame([(*(r.get(k) for k in ("chapter_id", "book", "chapter", "url", "audio_file")), k) for k, r in enumerate(rows)], "chapter_id string, book string, chapter int, url string, audio_file string, seq long")


def write_json(spark: SparkSession, path: str, data: Any) -> None:
    """Replaces a small JSON file at once: written beside it, then renamed over it. Readers see the old or the new one."""
    made, files = hadoop_path(spark, path)
    aside, _ = hadoop_path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    if made.getParent() is not None:
        files.mkdirs(made.getParent())
    out = files.create(aside, True)
    try:
        out.write((json.dumps(data, ensure_ascii=False, indent=2) + "\n").encode())
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri() if made.toUri().getScheme() else files.getUri(), spark._jsc.hadoopConfiguration())
    options = spark._jvm.org.apache.hadoop.fs.Options
    flags = spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 1)
    flags[0] = getattr(options, "Rename").OVERWRITE
    context.rename(files.makeQualified(aside), files.makeQualified(made), flags)


def write_completed(completed: DataFrame, path: str) -> None:
    """{"completed": [...]}: the distinct ids in order, replaced at once. A list of chapters, so it fits in the driver."""
    ids = completed.agg(F.array_sort(F.collect_set("chapter_id")).alias("ids")).first()["ids"]
    write_json(completed.sparkSession, path, {"completed": ids})


def write_failed(failed: DataFrame, path: str) -> None:
    """{"failed": [...]}: the last entry of each chapter, in the place of its first; failed(chapter, reason, attempts, seq)."""
    kept = logs.keep_last_at_first(failed, "chapter", "seq").orderBy("place").collect()
    write_json(failed.sparkSession, path, {"failed": [{k: r[k] for k in ("chapter", "reason", "attempts")} for r in kept]})


def write_csv(rows: DataFrame, path: str, columns: tuple[str, ...], order: list[str] | None = None) -> None:
    """Replaces a folder of CSV files with a header and the given columns; rows with other columns are an error, as are missing ones."""
    if set(rows.columns) != set(columns):
        raise ValueError(f"columns {sorted(set(rows.columns) ^ set(columns))} are too many or missing")
    out = rows.orderBy(*order) if order else rows
    out.select(*columns).write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a log of Parquet files."""
    rows.write.mode("append").parquet(path)


def write_jsonl(rows: DataFrame, folder: str, split: str, names: tuple[str, ...]) -> None:
    """One folder of JSON lines for each name, replaced; those of names that have no rows now are empty, not stale."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").partitionBy(split).json(folder)
    for name in names:
        made, files = hadoop_path(spark, f"{folder}/{split}={name}")
        files.mkdirs(made)


def write_manifest(rows: DataFrame, path: str) -> None:
    """All of a manifest by utterance_id, or none: broken rules raise before anything is written."""
    write_csv(manifests.checked(rows), path, manifests.COLUMNS, order=["utterance_id"])


def write_gold(rows: DataFrame, path: str, seq: str) -> None:
    """All segments, or none: broken rules raise before anything is written."""
    checked = gold.checked(rows, seq)
    write_csv(checked.select(*gold.COLUMNS), path, gold.COLUMNS)


def write_splits(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the three splits into folders split=<name>, after the guard against leaks; returns their summary."""
    manifests.guarded(rows)
    rows.filter(F.col("split").isin(*SPLITS)).write.mode("overwrite").partitionBy("split").option("header", "true").option("escape", '"').csv(folder)
    return manifests.split_summary(rows)

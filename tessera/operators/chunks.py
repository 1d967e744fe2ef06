"""Long recordings in chunks: settings, cuts in pauses, stitching of overlapping texts, grouping of units. One recording is one row."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import logs

#: Seconds of a frame, words of a seam on each side, the least words that two texts must share, and the settings' environment variables.
FRAME_SEC, SEAM_WORDS, LEAST_SHARED = 0.025, 30, 2
VARIABLES = {"target_sec": "ASR_CHUNK_SEC", "max_sec": "ASR_CHUNK_MAX_SEC", "overlap_sec": "ASR_CHUNK_OVERLAP_SEC"}


@dataclass(frozen=True)
class ChunkSettings:
    """Seconds of a chunk: from target to max, of which overlap are shared with the one before."""

    target_sec: float = 20.0
    max_sec: float = 30.0
    overlap_sec: float = 0.0

    def __post_init__(self):
        if not 0 < self.target_sec <= self.max_sec or not 0 <= self.overlap_sec < self.target_sec:
            raise ValueError("0 < target_sec <= max_sec and 0 <= overlap_sec < target_sec are needed")

    @classmethod
    def resolved(cls, environment: dict[str, str] | None = None, **given: float | None) -> ChunkSettings:
        """What is given, else what the environment says, else the defaults."""
        found = os.environ if environment is None else environment
        pick = lambda f: given.get(f.name) if given.get(f.name) is not None else float(found.get(VARIABLES[f.name], f.default))
        return cls(**{f.name: pick(f) for f in fields(cls)})


def cuts(samples: np.ndarray, rate: int, settings: ChunkSettings) -> list[tuple[int, int]]:
    """(start, end) of chunks that cover a signal. A cut lies in the middle of the quietest frame between target and max, the first of equal ones."""
    size, frame = len(samples), max(1, int(FRAME_SEC * rate))
    soft, hard, shared = (int(s * rate) for s in (settings.target_sec, settings.max_sec, settings.overlap_sec))
    found: list[tuple[int, int]] = []
    at = 0
    while size - at > hard:
        whole = (hard - soft) // frame
        if whole:
            room = samples[at + soft : at + soft + whole * frame].reshape(whole, frame)
            quiet = int(np.square(room).mean(axis=1).argmin())
            end = at + soft + quiet * frame + frame // 2
        else:
            end = at + hard
        found.append((at, end))
        at = max(end - shared, at + 1)
    return [*found, (at, size)] if at < size else found


def planned(signals: DataFrame, key: str, samples: str, rate: str, settings: ChunkSettings) -> DataFrame:
    """(key, chunk_index, start, end, start_sec, end_sec) of each signal's chunks; a null or empty signal has none."""

    @F.pandas_udf("array<struct<start:long,end:long>>")
    def plan(signal: pd.Series, per_second: pd.Series) -> pd.Series:
        each = zip(signal, per_second, strict=True)
        return pd.Series([[] if s is None else [{"start": a, "end": b} for a, b in cuts(np.asarray(s, np.float32), int(r), settings)] for s, r in each])

    listed = signals.select(key, F.col(rate).alias("_rate"), F.posexplode(plan(F.col(samples), F.col(rate))).alias("chunk_index", "_c"))
    return listed.select(key, F.col("chunk_index").cast("long").alias("chunk_index"), "_c.start", "_c.end", (F.col("_c.start") / F.col("_rate")).alias("start_sec"), (F.col("_c.end") / F.col("_rate")).alias("end_sec"))


def longest_common_run(left: list[str], right: list[str]) -> tuple[int, int, int]:
    """(start in left, start in right, words) of the longest run that both have; the earliest in left, then in right, of equal ones."""
    best = (0, 0, 0)
    ends = [0] * (len(right) + 1)  # words of the common run that ends before this place
    for i, word in enumerate(left):
        row = [0] * (len(right) + 1)
        for j, other in enumerate(right):
            if word == other:
                row[j + 1] = n = ends[j] + 1
                if n > best[2] or (n == best[2] and (i + 1 - n, j + 1 - n) < best[:2]):
                    best = (i + 1 - n, j + 1 - n, n)
        ends = row
    return best


def stitched(texts: list[str | None], overlapping: bool) -> str:
    """Texts of consecutive chunks as one. Overlapping ones meet at the run of words that the end of one and the beginning of the next share; without one they follow each other."""
    out: list[str] = []
    for part in texts:
        new = (part or "").split()
        if overlapping and out and new:
            base = max(0, len(out) - SEAM_WORDS)
            a, b, n = longest_common_run(out[base:], new[:SEAM_WORDS])
            if n >= LEAST_SHARED:
                out, new = out[: base + a + n], new[b + n :]
        out += new
    return " ".join(out)


def stitched_texts(chunks: DataFrame, key: str, order: str, text: str, overlapping: bool) -> DataFrame:
    """(key, text) of each recording; its chunks, in their order, are one row of the aggregate."""

    @F.pandas_udf("string")
    def join(parts: pd.Series) -> pd.Series:
        return pd.Series([stitched([p["text"] for p in one], overlapping) for one in parts])

    listed = chunks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("place"), F.col(text).alias("text")))).alias("_parts"))
    return listed.select(key, join("_parts").alias("text"))


def grouped_units(spans: Column, longest: float) -> Column:
    """Spans (array of struct<start, end>, in order) as array of struct<first, last, start, end>: as many neighbours as fit in `longest` seconds each.

    A unit opens a new group where its end lies more than that after the start of the group's first. Groups meet in the middle of the gap between
    their units; the first starts and the last ends where its unit does. A fold over the array, so that all of it stays in the JVM.
    """
    entry = "array<struct<first:int,last:int>>"
    size = F.size(spans)

    def step(groups: Column, i: Column) -> Column:
        now = F.element_at(groups, -1)
        joins = (F.size(groups) > 0) & (F.get(spans, i)["end"] - F.get(spans, now["first"])["start"] <= longest)
        extended = F.concat(F.slice(groups, 1, F.size(groups) - 1), F.array(F.struct(now["first"].alias("first"), i.alias("last"))))
        return F.when(F.coalesce(joins, F.lit(False)), extended).otherwise(F.concat(groups, F.array(F.struct(i.alias("first"), i.alias("last"))))).cast(entry)

    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    groups = F.aggregate(places, F.array().cast(entry), step)

    def bounds(g: Column) -> Column:
        before, own = F.get(spans, g["first"] - 1), F.get(spans, g["first"])
        end, after = F.get(spans, g["last"]), F.get(spans, g["last"] + 1)
        start = F.when(g["first"] == 0, own["start"]).otherwise((before["end"] + own["start"]) / 2)
        stop = F.when(g["last"] == size - 1, end["end"]).otherwise((end["end"] + after["start"]) / 2)
        return F.struct(g["first"].alias("first"), g["last"].alias("last"), start.alias("start"), stop.alias("end"))

    return F.transform(groups, bounds)


def unit_groups(units: DataFrame, key: str, order: str, longest: float) -> DataFrame:
    """(key, place, first, last, start, end) of the groups of units(key, order, start, end)."""
    listed = units.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), "start", "end"))).alias("_u"))
    spans = F.transform("_u", lambda u: F.struct(u["start"].alias("start"), u["end"].alias("end")))
    found = listed.select(key, spans.alias("_s")).select(key, F.posexplode(grouped_units(F.col("_s"), longest)).alias("place", "_g"))
    return found.select(key, "place", "_g.first", "_g.last", "_g.start", "_g.end")


Transcribe = Callable[[np.ndarray, int], str]


def transcribed(plan: DataFrame, signals: DataFrame, key: str, transcribe: Transcribe, done: DataFrame | None = None) -> DataFrame:
    """(key, chunk_index, start_sec, end_sec, prediction, status, error_message) of planned chunks, by a given function of samples and rate.

    done(key, chunk_index, prediction): chunks that are there are not made again. A failure is a row, not the end of the task. signals(key, samples, rate).
    """
    names = [key, "chunk_index", "start_sec", "end_sec", "prediction", "status", "error_message"]
    todo = plan if done is None else plan.join(done.select(key, "chunk_index"), [key, "chunk_index"], "left_anti")
    cut = todo.join(signals.select(key, "samples", "rate"), key).select(key, "chunk_index", "start_sec", "end_sec", F.slice("samples", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")).alias("samples"), "rate")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                try:
                    said = transcribe(np.asarray(batch.column(4)[k].as_py(), np.float32), batch.column(5)[k].as_py())
                    out.append((said, "ok", ""))
                except Exception as error:  # told in the row; the next try takes it up
                    out.append(("", "failed", str(error)))
            columns = [pa.array([o[j] for o in out], pa.string()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], names)

    schema = cut.select(*names[:4]).schema
    for name in names[4:]:
        schema = schema.add(name, "string")
    made = cut.mapInArrow(run, schema)
    if done is None:
        return made
    kept = plan.join(done.select(key, "chunk_index", "prediction"), [key, "chunk_index"]).select(*names[:5], F.lit("ok").alias("status"), F.lit("").alias("error_message"))
    return kept.unionByName(made)


def batch_results(chunks: DataFrame, key: str, overlapping: bool) -> DataFrame:
    """(key, prediction, status, error_message) of recordings: failed, with the number of chunks, where one of them failed."""
    told = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("status") != "ok").alias("_bad"))
    texts = stitched_texts(chunks, key, "chunk_index", "prediction", overlapping)
    bad = F.col("_bad") > 0
    reason = F.format_string("%d/%d chunks failed; rerun to retry them", "_bad", "_n")
    return told.join(texts, key).select(key, F.when(bad, "").otherwise(F.col("text")).alias("prediction"), F.when(bad, "failed").otherwise("ok").alias("status"), F.when(bad, reason).otherwise("").alias("error_message"))


def resumable(log: DataFrame, key: str) -> DataFrame:
    """The chunks of a log that need not be made again: the last try went well."""
    return logs.latest_wins(log, [key, "chunk_index"], F.col("seq"), F.col("status") == "ok")

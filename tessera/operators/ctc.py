"""Forced alignment of token sequences to frame log-probabilities, and what follows from it. One chapter is one row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tessera.functions import text
from tessera.functions.numbers import exact_round
from tessera.operators.chunks import grouped_units

LOW = -1e30
SPANS = ArrayType(StructType([StructField("first", IntegerType()), StructField("last", IntegerType())]))


def viterbi(frames: np.ndarray, tokens: list[int], blank: int) -> list[tuple[int, int]]:
    """(first, last) frame of each token on the best path.

    States are: frames before the text, a blank and a token by turns, a last blank, frames after the text. Frames outside the text score as their best
    symbol, so they don't matter. A token follows another without a blank between only if they differ. Of equal paths the one that stays is taken, then the one
    from the state before, then the skip; the text starts as early and ends as early as it can. Back-pointers take a byte a cell.
    """
    if not tokens:
        raise ValueError("no tokens to align")
    symbols = np.full(2 * len(tokens) + 1, blank, np.int64)
    symbols[1::2] = tokens
    repeats = symbols[3::2] == symbols[1:-2:2]
    if len(frames) < len(tokens) + int(repeats.sum()):
        raise ValueError(f"audio too short: {len(frames)} frames for {len(tokens)} tokens")
    inside = len(symbols)
    outer, last = frames.max(axis=1), inside + 1  # state 0: before, 1..inside: the text, last: after
    emit = np.empty((len(frames), inside + 2))
    emit[:, 0] = emit[:, last] = outer
    emit[:, 1:last] = frames[:, symbols]
    skips = np.zeros(inside + 2, bool)
    skips[4:last:2] = ~repeats
    score = np.full(inside + 2, LOW)
    score[:3] = 0, emit[0, 1], emit[0, 2]
    score[0] = outer[0]
    step = np.zeros((len(frames), inside + 2), np.uint8)
    step[0, 1:3] = 1, 2
    lanes = np.arange(inside + 2)
    for t in range(1, len(frames)):
        ways = np.full((3, inside + 2), LOW)
        ways[0] = score
        ways[1, 2:] = score[1:-1]
        ways[2] = np.where(skips, np.concatenate([[LOW, LOW], score[:-2]]), LOW)
        ways[1, 1] = score[0]  # into the first blank or the first token from the frames before
        ways[2, 2] = score[0]
        ways[2, last] = score[last - 2]
        pick = ways.argmax(axis=0)
        step[t] = pick
        score = ways[pick, lanes] + emit[t]
    ends = [last, last - 1, last - 2]
    within = max(score[last - 1], score[last - 2])
    state = ends[0] if score[last] > within else (ends[1] if score[last - 1] >= score[last - 2] else ends[2])
    found = np.full((len(tokens), 2), -1)
    for t in range(len(frames) - 1, -1, -1):
        if state == 0:
            break
        if 0 < state < last and state % 2 == 0:
            k = state // 2 - 1
            found[k, 0] = t
            if found[k, 1] < 0:
                found[k, 1] = t
        state -= int(step[t, state])
    return [(int(a), int(b)) for a, b in found]


def aligned(chapters: DataFrame, key: str, blank: int) -> DataFrame:
    """(key, spans, scores, error) of chapters(key, log_probs array<array<double>>, tokens array<int>).

    scores: each token's mean log-probability over its frames. What can't be aligned has an error instead; the task goes on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, scores, errors = [], [], []
            for frames, tokens in zip(batch.column(1), batch.column(2), strict=True):
                try:
                    matrix, own = np.array(frames.as_py() or [], np.float64), tokens.as_py() or []
                    path = viterbi(matrix, own, blank)
                    spans.append([{"first": a, "last": b} for a, b in path])
                    scores.append([float(matrix[a : b + 1, k].mean()) for (a, b), k in zip(path, own, strict=True)])
                    errors.append(None)
                except ValueError as error:
                    spans.append(None)
                    scores.append(None)
                    errors.append(str(error))
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(scores, pa.list_(pa.float64())), pa.array(errors, pa.string())], [key, "spans", "scores", "error"])

    schema = chapters.select(key).schema.add("spans", SPANS).add("scores", ArrayType(DoubleType())).add("error", "string")
    return chapters.select(key, "log_probs", "tokens").mapInArrow(run, schema)


def best_symbols(log_probs: Column) -> Column:
    """The first of the likeliest symbols of each frame."""
    return F.transform(log_probs, lambda row: F.array_position(row, F.array_max(row)).cast("int") - 1)


def greedy_ids(log_probs: Column, blank: int) -> Column:
    """Symbols of a greedy decode: blanks and repeats without a blank between go."""
    return collapsed(best_symbols(log_probs), blank)


def collapsed(best: Column, blank: int) -> Column:
    pairs = F.arrays_zip(best.alias("now"), F.concat(F.array(F.lit(-1)), F.slice(best, 1, F.greatest(F.size(best) - 1, F.lit(0)))).alias("before"))
    return F.transform(F.filter(pairs, lambda p: (p["now"] != blank) & (p["now"] != p["before"])), lambda p: p["now"])


def chapter_segments(chapters: DataFrame, key: str, blank: int, ids_to_text: Callable[[list[int]], str], longest: float = 20.0) -> DataFrame:
    """Segments of chapters(key, log_probs, times, frame_sec, units array<struct<kind, ref, text, tokens>>).

    (key, segment_id, start_sec, end_sec, units, n_headings, text, align_score, raw_asr, cer_vs_raw_asr, error). Units are grouped to at most `longest` seconds; align_score
    is the mean over the tokens of a segment. A chapter that can't be aligned is one row with its error.
    """

    @F.udf("string")  # the given function sees one segment's ids at a time, after all else is done in the JVM
    def said(ids):
        return ids_to_text([int(i) for i in ids]).strip() if ids else ""

    tokens = F.flatten(F.transform("units", lambda u: u["tokens"]))
    full = chapters.withColumn("tokens", tokens)
    found = full.join(aligned(full, key, blank), key)
    sizes = F.transform("units", lambda u: F.size(u["tokens"]))
    ends = F.transform(F.sequence(F.lit(1), F.size("units")), lambda n: F.aggregate(F.slice(F.col("_sizes"), 1, n), F.lit(0), lambda a, x: a + x))
    ok = found.filter("error is null").withColumn("_sizes", sizes).withColumn("_ends", ends)
    at = lambda i: F.get("_ends", i) - F.get("_sizes", i)
    moment = lambda i: F.get("times", i)
    spans = F.transform(F.sequence(F.lit(0), F.size("units") - 1), lambda i: F.struct(moment(F.get("spans", at(i))["first"]).alias("start"), (moment(F.get("spans", F.get("_ends", i) - 1)["last"]) + F.col("frame_sec")).alias("end")))
    ok = ok.withColumn("_spans", spans).withColumn("_groups", grouped_units(F.col("_spans"), longest))
    one = ok.select("*", F.posexplode("_groups").alias("_place", "_g"))
    mine = F.slice("units", F.col("_g.first") + 1, F.col("_g.last") - F.col("_g.first") + 1)
    refs = F.filter(F.transform(mine, lambda u: u["ref"]), lambda r: F.coalesce(r, F.lit("")) != "")
    first, stop = at(F.col("_g.first")), F.get("_ends", F.col("_g.last"))
    scores = F.slice("scores", first + 1, stop - first)
    inside = F.filter(F.arrays_zip(F.col("times").alias("t"), F.col("log_probs").alias("p")), lambda x: (x["t"] >= F.col("_g.start")) & (x["t"] < F.col("_g.end")))
    made = one.select(
        key,
        F.concat(F.col(key).cast("string"), F.format_string("_a%03d", "_place")).alias("segment_id"),
        exact_round(F.col("_g.start"), 3).alias("start_sec"),
        exact_round(F.col("_g.end"), 3).alias("end_sec"),
        F.when(F.size(refs) > 0, F.concat(F.get(refs, F.lit(0)), F.lit(".."), F.element_at(refs, -1))).otherwise("heading").alias("units"),
        F.size(F.filter(mine, lambda u: u["kind"] == "heading")).alias("n_headings"),
        F.array_join(F.transform(mine, lambda u: u["text"]), " ").alias("text"),
        exact_round(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores), 4).alias("align_score"),
        said(greedy_ids(F.transform(inside, lambda x: x["p"]), blank)).alias("raw_asr"),
    )
    rate = text.error_rate(text.strip_punctuation(F.col("text")), text.strip_punctuation(F.col("raw_asr")))
    made = made.withColumn("cer_vs_raw_asr", F.when(F.col("raw_asr") != "", exact_round(rate, 4))).withColumn("error", F.lit(None).cast("string"))
    failed = found.filter("error is not null").select(key, "error")
    return made.unionByName(failed, allowMissingColumns=True)

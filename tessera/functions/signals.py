"""Loudness, clipping and silence of signals held as arrays, as column expressions: no Python, one pass for each figure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a frame, silence and floor in dBFS, the least amplitude, clipping level, and the limits of a recording's quality.
FRAME_SEC, SILENCE_DBFS, EMPTY_DBFS, LEAST = 0.025, -40.0, -120.0, 1e-12
CLIP_LEVEL, CLIP_POOR, QUIET_DBFS, LOUD_FAIR_DBFS = 0.999, 0.001, -40.0, -30.0


def mean_square(samples: Column) -> Column:
    squares = F.aggregate(samples, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return squares / F.size(samples)


def decibels(amplitude: Column) -> Column:
    return F.log10(F.greatest(amplitude, F.lit(LEAST))) * 20


def clipped_share(samples: Column) -> Column:
    return F.size(F.filter(samples, lambda x: F.abs(x) >= F.lit(CLIP_LEVEL).cast("float"))) / F.size(samples)


def frames(samples: Column, frame: Column) -> Column:
    """Whole frames of a signal; a shorter signal is one frame, an empty one none."""
    count = F.floor(F.size(samples) / frame).cast("int")
    whole = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(samples, i * frame + 1, frame))
    return F.when(F.size(samples) == 0, F.array().cast("array<array<float>>")).when(count == 0, F.array(samples)).otherwise(whole)


def audio_signals(samples: Column, frame: Column) -> Column:
    """struct<silence_ratio, clip_ratio, rms_dbfs> of an array of floats; null for null.

    frame: samples of a frame (FRAME_SEC of them, at least 1). An empty signal is all silence.
    """
    loud = F.transform(frames(samples, frame), lambda one: decibels(F.sqrt(mean_square(one))))
    silent = F.size(F.filter(loud, lambda x: x < SILENCE_DBFS)) / F.size(loud)
    full = F.struct(silent.alias("silence_ratio"), clipped_share(samples).alias("clip_ratio"), decibels(F.sqrt(mean_square(samples))).alias("rms_dbfs"))
    empty = F.struct(F.lit(1.0).alias("silence_ratio"), F.lit(0.0).alias("clip_ratio"), F.lit(EMPTY_DBFS).alias("rms_dbfs"))
    return F.when(F.size(samples) > 0, full).when(F.size(samples) == 0, empty)


def frame_of(rate: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(rate * FRAME_SEC).cast("int"))


def recording_quality(samples: Column) -> Column:
    """poor, fair or good; poor comes first. Silence and an empty signal are poor; null stays null."""
    dbfs = F.log10(F.sqrt(mean_square(samples))) * 20  # null for silence
    poor = (clipped_share(samples) > CLIP_POOR) | F.coalesce(dbfs < QUIET_DBFS, F.lit(True))
    return F.when(samples.isNull(), None).when(F.size(samples) == 0, "poor").when(poor, "poor").when(dbfs < LOUD_FAIR_DBFS, "fair").otherwise("good")


def clip(samples: Column, rate: Column, start: Column, end: Column) -> Column:
    """The samples from start to end in seconds; without a start from the beginning, without an end to the end."""
    first = F.coalesce(F.floor(start * rate), F.lit(0)).cast("int")
    last = F.least(F.coalesce(F.floor(end * rate).cast("int"), F.size(samples)), F.size(samples))
    return F.slice(samples, first + 1, F.greatest(last - first, F.lit(0)))

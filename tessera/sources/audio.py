"""PCM WAV files as arrays of samples: decoding, mono, resampling, validity, and clips as WAV bytes. Other formats need a decoder that isn't here."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import signals

#: The rate that models take, and zero crossings of the resampler's window on each side.
RATE, CROSSINGS = 16_000, 16
CLIPS = "path string, rate int, samples array<float>, duration_sec double, valid boolean, reason string"


def decoded(raw: bytes) -> tuple[np.ndarray, int]:
    """(frames x channels from -1 to 1, rate) of PCM WAV bytes with 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(raw)) as f:
        width, channels, rate, data = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.readframes(f.getnframes())
    if width == 1:  # the only unsigned one
        flat = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        parts = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        flat = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) / 2**31).astype(np.float32)
    else:
        flat = (np.frombuffer(data, {2: "<i2", 4: "<i4"}[width]) / 2 ** (8 * width - 1)).astype(np.float32)
    return flat.reshape(-1, channels), rate


def mono(frames: np.ndarray) -> np.ndarray:
    """The mean of the channels."""
    return frames if frames.ndim == 1 else frames.mean(axis=1)


def resampled(samples: np.ndarray, rate: int, wanted: int = RATE) -> np.ndarray:
    """A signal at another rate, by a windowed sinc that passes what both rates can hold; ceil(n * wanted / rate) samples."""
    if rate == wanted or not len(samples):
        return samples
    size, cut = -(-len(samples) * wanted // rate), min(1.0, wanted / rate)
    reach = int(np.ceil(CROSSINGS / cut))
    out = np.zeros(size, np.float32)
    padded = np.pad(samples.astype(np.float64), reach)
    for at in range(0, size, 1 << 15):
        where = np.arange(at, min(size, at + (1 << 15))) * (rate / wanted)
        base = np.floor(where).astype(np.int64)
        offset = np.arange(-reach + 1, reach + 1)
        far = offset[None] - (where - base)[:, None]
        weight = cut * np.sinc(cut * far) * (0.5 + 0.5 * np.cos(np.pi * np.clip(far / reach, -1, 1)))
        out[at : at + len(where)] = (padded[base[:, None] + offset[None] + reach] * weight).sum(1)
    return out


def loaded(raw: bytes | None, wanted: int | None = RATE) -> tuple[np.ndarray, int]:
    """(mono samples, rate) of WAV bytes at the wanted rate, or at their own for None."""
    if raw is None:
        raise ValueError("file does not exist")
    frames, rate = decoded(raw)
    one = mono(frames)
    return (one, rate) if wanted is None else (resampled(one, rate, wanted), wanted)


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """Mono 16-bit PCM."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.clip(np.rint(np.asarray(samples, np.float64) * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def read_audio(spark: SparkSession, pattern: str, wanted: int | None = RATE) -> DataFrame:
    """(path, rate, samples, duration_sec, valid, reason) of files; one that can't be read is a row that says why."""
    return decoded_rows(spark.read.format("binaryFile").load(pattern).select("path", "content"), wanted)


def decoded_rows(files: DataFrame, wanted: int | None = RATE) -> DataFrame:
    """The same of files(path, content). A file is one row; Arrow batches hold few of them (spark.sql.execution.arrow.maxRecordsPerBatch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("rate", pa.int32()), ("samples", pa.list_(pa.float32())), ("duration_sec", pa.float64()), ("valid", pa.bool_()), ("reason", pa.string())])
        for batch in batches:
            for k in range(batch.num_rows):  # a batch for each file: signals are long
                path = batch.column(0)[k].as_py()
                try:
                    samples, rate = loaded(batch.column(1)[k].as_py(), wanted)
                    seconds = len(samples) / rate
                    row = {"path": path, "rate": rate, "samples": samples.astype(np.float32), "duration_sec": seconds, "valid": seconds > 0, "reason": f"valid audio, {seconds:.2f}s" if seconds > 0 else "zero-length audio"}
                except (ValueError, EOFError, KeyError, wave.Error) as error:
                    row = {"path": path, "rate": None, "samples": None, "duration_sec": 0.0, "valid": False, "reason": str(error) if str(error) == "file does not exist" else f"could not decode audio: {error}"}
                yield pa.RecordBatch.from_pylist([row], schema)

    return files.select("path", "content").mapInArrow(run, CLIPS)


def encoded(samples: Column, rate: Column) -> Column:
    """WAV bytes of arrays of samples."""

    @F.udf("binary")
    def made(one, per_second):
        return None if one is None else wav_bytes(np.asarray(one), int(per_second))

    return made(samples, rate)


def clips(segments: DataFrame, audio: DataFrame) -> DataFrame:
    """segments(segment_id, audio_path, start_sec, end_sec) with the WAV bytes of each, cut from audio(path, samples, rate)."""
    bound = lambda c: F.col(c).cast("string").try_cast("double")
    cut = segments.join(audio.select(F.col("path").alias("audio_path"), "samples", "rate"), "audio_path")
    cut = cut.withColumn("samples", signals.clip(F.col("samples"), F.col("rate"), bound("start_sec"), bound("end_sec")))
    return cut.select("segment_id", encoded(F.col("samples"), F.col("rate")).alias("wav"), (F.size("samples") / F.col("rate")).alias("duration_sec"))

"""Ramps, plateaus and the weighted triage score as column expressions. Nothing is rounded here."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

Limits = tuple[float, float, float, float]


@dataclass(frozen=True)
class TriageSettings:
    """Weights, ramps (bad, good), plateaus (hard_min, min_ok, max_ok, hard_max), penalties and thresholds; each can be replaced for a run."""

    # The defaults.
    version: str = "triage-v1"
    weights: dict[str, float] = field(default_factory=lambda: {"alignment": 0.35, "agreement": 0.3, "audio_quality": 0.15, "duration": 0.1, "speaking_rate": 0.1})
    ramps: dict[str, tuple[float, float]] = field(
        default_factory=lambda: {
            "align_score": (-2.0, -0.5),
            "cer_vs_asr": (0.45, 0.12),
            "insert_delete_rate": (0.35, 0.05),
            "silence_ratio": (0.7, 0.3),
            "clip_ratio": (0.01, 0.0005),
            "rms_dbfs_low": (-40.0, -30.0),
            "rms_dbfs_high": (-1.0, -6.0),
        }
    )
    duration: Limits = (1.0, 3.0, 25.0, 45.0)
    chars_per_sec: Limits = (4.5, 6.5, 12.5, 16.0)
    penalties: dict[str, float] = field(default_factory=lambda: {"parentheses": 0.25, "digits_or_latin": 0.15, "repeated_word": 0.15, "empty_asr": 0.3, "contains_heading": 0.05})
    blocking: tuple[str, ...] = ("parentheses", "empty_asr", "empty_candidate", "duration_out_of_range", "mostly_silence")
    hard: tuple[str, ...] = ("empty_candidate", "duration_out_of_range", "speaking_rate_out_of_range", "mostly_silence")
    correctable: tuple[str, ...] = ("parentheses",)
    high_confidence: float = 0.9
    review: float = 0.5

    def __post_init__(self):
        if not 0 <= self.review <= self.high_confidence <= 1:
            raise ValueError("thresholds: 0 <= review <= high_confidence <= 1 is needed")

    def with_thresholds(self, high_confidence: float | None = None, review: float | None = None) -> TriageSettings:
        given = {"high_confidence": high_confidence, "review": review}
        return replace(self, **{k: v for k, v in given.items() if v is not None})

    @classmethod
    def from_json(cls, text: str) -> TriageSettings:
        """Settings from a JSON object with ramps as {bad, good}, plateaus as {hard_min, min_ok, max_ok, hard_max}."""
        raw = json.loads(text)
        four = lambda d: tuple(float(d[k]) for k in ("hard_min", "min_ok", "max_ok", "hard_max"))
        return cls(
            version=raw["version"],
            weights=raw["weights"],
            ramps={k: (float(v["bad"]), float(v["good"])) for k, v in raw["ramps"].items()},
            duration=four(raw["duration_sec"]),
            chars_per_sec=four(raw["chars_per_sec"]),
            penalties=raw["artifact_penalties"],
            blocking=tuple(raw["blocking_flags"]),
            correctable=tuple(raw.get("never_reject_flags", ())),
            high_confidence=raw["thresholds"]["high_confidence"],
            review=raw["thresholds"]["review"],
        )


DEFAULTS = TriageSettings()


def clipped(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def ramp(value: Column, bad: float, good: float) -> Column:
    """0 at bad, 1 at good, linear between; null and NaN are 0."""
    return F.when(value.isNull() | F.isnan(value), 0.0).otherwise(clipped((value - bad) / (good - bad)))


def plateau(value: Column, limits: Limits) -> Column:
    hard_min, min_ok, max_ok, hard_max = limits
    return F.when(value < min_ok, ramp(value, hard_min, min_ok)).when(value > max_ok, ramp(value, hard_max, max_ok)).otherwise(1.0)


def any_of(flags: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(flags, F.array(*map(F.lit, names))) if names else F.lit(False)


def components(duration: Column, rate: Column, align: Column, cer: Column, insert_delete: Column, silence: Column, clip: Column, rms: Column, settings: TriageSettings = DEFAULTS) -> dict[str, Column]:
    """The five components, each from 0 to 1. A missing align score or signal scores 0."""
    r = settings.ramps
    loud = F.least(ramp(rms, *r["rms_dbfs_low"]), ramp(rms, *r["rms_dbfs_high"]))
    return {
        "alignment": ramp(align, *r["align_score"]),
        "agreement": (ramp(cer, *r["cer_vs_asr"]) + ramp(insert_delete, *r["insert_delete_rate"])) / 2,
        "audio_quality": F.when(silence.isNull(), 0.0).otherwise((ramp(silence, *r["silence_ratio"]) + ramp(clip, *r["clip_ratio"]) + loud) / 3),
        "duration": plateau(duration, settings.duration),
        "speaking_rate": plateau(rate, settings.chars_per_sec),
    }


def late_flags(align: Column, silence: Column, duration_part: Column, rate_part: Column, settings: TriageSettings = DEFAULTS) -> Column:
    """Flags that follow those of the text."""
    # Names of the flags.
    rules = [
        ("missing_align_score", align.isNull()),
        ("audio_unavailable", silence.isNull()),
        ("duration_out_of_range", duration_part == 0),
        ("speaking_rate_out_of_range", rate_part == 0),
        ("mostly_silence", silence >= settings.ramps["silence_ratio"][0]),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))


def verdict(parts: dict[str, Column], flags: Column, settings: TriageSettings = DEFAULTS) -> dict[str, Column]:
    """Confidences, penalty and status from the components and all flags; names of columns, so that none is computed twice."""
    weighted = sum(parts[k] * w for k, w in settings.weights.items()) / sum(settings.weights.values())
    penalty = sum((F.when(F.array_contains(flags, k), p).otherwise(0.0) for k, p in settings.penalties.items()), F.lit(0.0))
    base, confidence = clipped(weighted), clipped(weighted - penalty)
    rejected = any_of(flags, settings.hard) | ((base < settings.review) & ~any_of(flags, settings.correctable))
    # The statuses.
    status = F.when(rejected, "REJECT_CANDIDATE").when((confidence >= settings.high_confidence) & ~any_of(flags, settings.blocking), "HIGH_CONFIDENCE_CANDIDATE").otherwise("NEEDS_REVIEW")
    return {"base_confidence": base, "artifact_penalty": penalty, "confidence_score": confidence, "triage_status": status}

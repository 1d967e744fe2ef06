"""Recordings of speakers: pseudonyms by a keyed hash, the gate and the numbers of new recordings, withdrawal."""

from __future__ import annotations

import hashlib
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.signals import recording_quality
from tessera.operators import logs
from tessera.operators.manifests import COLUMNS, NATIVE
from tessera.operators.numbering import numbered, sequence_id
from tessera.operators.shared import kept

#: The pseudonyms' prefix, the registry's columns, the least and most seconds of a recording.
PREFIX, REGISTRY, SECONDS = "VH_S", ("speaker_id", "key_hash", "status", "registered_on"), (0.5, 600.0)


def keyed_hash(message: Column, key: bytes) -> Column:
    """HMAC with SHA-256 in lower-case hex, from two hashes over the padded key; all in SQL functions."""
    if not key:
        raise ValueError("an empty key would make pseudonyms that anyone can derive")
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def key_hash(key: Column, salt: str) -> Column:
    """The hash of a speaker's key; case and white space around it don't count."""
    return keyed_hash(F.lower(text.stripped(key)), salt.encode())


def identified(people: DataFrame, registry: DataFrame, salt: str, seq: str, today: date) -> tuple[DataFrame, DataFrame]:
    """(people with speaker_id instead of speaker_key, the registry with the new speakers).

    A hash that is active in the registry has its pseudonym; others get the next free numbers in the order they first come. Numbers are never used again.
    """
    hashed = people.withColumn("key_hash", key_hash(F.coalesce("speaker_key", F.lit("")), salt)).drop("speaker_key")
    active = registry.filter("status = 'active'").groupBy("key_hash").agg(F.min("speaker_id").alias("speaker_id"))
    new = hashed.groupBy("key_hash").agg(F.min(seq).alias("_first")).join(active, "key_hash", "left_anti")
    taken = registry.agg(F.coalesce(F.max(F.substring("speaker_id", len(PREFIX) + 1, 20).try_cast("long")), F.lit(0)).alias("_taken"))
    named = numbered(new, "_first", "_n").crossJoin(F.broadcast(taken))  # one row
    named = kept(named.select("key_hash", F.concat(F.lit(PREFIX), F.format_string("%03d", F.col("_n") + F.col("_taken"))).alias("speaker_id")), "new-speakers")
    rows = hashed.join(active.unionByName(named.select(*active.columns)), "key_hash").drop("key_hash")
    added = named.select("speaker_id", "key_hash", F.lit("active").alias("status"), F.lit(today).alias("registered_on"))
    return rows, registry.select(*REGISTRY).unionByName(added)


def gated(recordings: DataFrame) -> DataFrame:
    """recordings(consent, duration_sec, valid, reason) with `rejected`: why it can't be taken, null if it can. Consent comes first."""
    seconds = F.col("duration_sec")
    low, high = SECONDS
    outside = F.format_string(f"recording rejected: duration %.2fs outside [{low}, {high}]", seconds)
    why = F.when(~F.coalesce(F.col("consent") == "given", F.lit(False)), "recording rejected: informed consent not given")
    why = why.when(~F.coalesce(F.col("valid"), F.lit(False)), F.concat(F.lit("recording rejected: "), F.coalesce("reason", F.lit("no audio"))))
    return recordings.withColumn("rejected", why.when(~F.coalesce(seconds.between(low, high), F.lit(False)), outside))


def registered(recordings: DataFrame, manifest: DataFrame, seq: str, dialect: str, folder: str = "recordings", language: str = "mr") -> DataFrame:
    """Manifest rows of accepted recordings(speaker_id, district, domain, age_group, gender, prompt_text, duration_sec, samples, seq): utterances are numbered after each speaker's last."""
    taken = manifest.groupBy("speaker_id").agg(F.max(F.substring_index("utterance_id", "_", -1).try_cast("long")).alias("_taken"))
    own = F.row_number().over(Window.partitionBy("speaker_id").orderBy(seq))
    rows = recordings.withColumn("_n", own).join(taken, "speaker_id", "left").withColumn("utterance_id", sequence_id(F.col("speaker_id"), F.col("_n") + F.coalesce("_taken", F.lit(0)), digits=4))
    asked = ~text.is_blank(F.col("prompt_text"))
    fixed = {"language": language, "dialect": dialect, "transcript": "", "consent_status": "given", "source": NATIVE, "license": "project consent form", "split": "unassigned"}
    made = rows.withColumns({k: F.lit(v) for k, v in fixed.items()}).withColumns({"audio_path": F.concat(F.lit(f"{folder}/"), "speaker_id", F.lit("/"), "utterance_id", F.lit(".wav")), "transcript_status": F.when(asked, "pending_review").otherwise("not_available"), "recording_quality": recording_quality(F.col("samples"))})
    return made.select(*COLUMNS)


def withdrawn(tables: dict[str, DataFrame], registry: DataFrame, speaker_id: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without the speaker's rows, the registry with its pseudonym retired and its hash gone)."""
    mine = F.col("speaker_id").eqNullSafe(F.lit(speaker_id))
    left = {name: rows.filter(~mine) for name, rows in tables.items()}
    gone = registry.withColumns({"key_hash": F.when(mine, "").otherwise(F.col("key_hash")), "status": F.when(mine, "withdrawn").otherwise(F.col("status"))})
    return left, gone


def withdrawn_all(tables: dict[str, DataFrame], speakers: DataFrame) -> dict[str, DataFrame]:
    """The same for many speakers(speaker_id) at once."""
    return {name: logs.to_do(rows, speakers, "speaker_id") for name, rows in tables.items()}

"""Every query of the engine by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import corpus, scoring, segments

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = scoring.QUERIES | segments.QUERIES | corpus.QUERIES
ORACLE_SQL: dict[str, str] = scoring.ORACLE_SQL | segments.ORACLE_SQL | corpus.ORACLE_SQL
FLAGSHIP = "corpus_wer_by_lang"

"""Tessera: a Spark-native engine for speech and text corpora."""

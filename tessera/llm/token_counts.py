"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only.

Texts go to the library in batches of about BATCH bytes, however many texts that is, so that no batch costs much more than another and none holds more than its
encodings. A text of over PART bytes is cut before lone spaces between ASCII letters or digits, where a pre-tokenizer that splits at spaces begins a new word; the parts' counts
add up. A text without such a place stays whole. Of an encoding only its length is taken. SentencePiece models see a text as one, so there nothing is cut.

Nulls and empty texts have 0 bytes and 0 tokens; repeated rows and null ids are kept as they are; an empty table gives no rows;
further columns of the input are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import byte_slices

#: Bytes of a batch, and of the parts of a long text, about.
BATCH, PART = 256 << 10, 64 << 10
SAFE = re.compile(rb"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
Counter = Callable[[list[str]], list[int]]
_made: dict[str, tuple[Counter, bool]] = {}


def counter(path: str) -> tuple[Counter, bool]:
    """(lengths of a batch of texts, whether texts may be cut) of a .json or .model file; one per worker and file."""
    if path not in _made:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _made[path] = (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), False
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.no_truncation()
            whole.no_padding()
            _made[path] = (lambda texts: [len(x) for x in whole.encode_batch_fast(texts, add_special_tokens=False)]), True
    return _made[path]


def safe_parts(raw: bytes, limit: int) -> Iterator[bytes]:
    """Parts of at least limit bytes (but the last), each cut at the next safe place; without one the rest stays whole."""
    start = 0
    while len(raw) - start > limit and (found := SAFE.search(raw, start + limit)):
        yield raw[start : found.start()]
        start = found.start()
    yield raw[start:]


def counted(texts: pa.Array, count: Counter, cut: bool, part: int = PART, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each text."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    sizes = pc.binary_length(texts).to_numpy()
    found = np.zeros(len(texts), np.int64)
    for a, b in byte_slices(sizes, batch):
        parts = [(row, p) for row in range(a, b) for p in (safe_parts(texts[row].as_py(), part) if cut else (texts[row].as_py(),)) if p]
        for i, j in byte_slices([len(p) for _, p in parts], batch):
            own = parts[i:j]
            np.add.at(found, [row for row, _ in own], count([p.decode() for _, p in own]))
    return sizes, found


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of docs(doc_id, text); tokenizer: a .json or .model file at the same path on each machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = counted(batch.column(1), *counter(tokenizer))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.int64()), pa.array(found > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

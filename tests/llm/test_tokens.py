"""Counts, ids and packings against the library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import packing, token_counts
from tessera.llm.word_tokens import WordTokens

P = pytest.importorskip("public_tokenizers")
WORDS, BYTES, PIECES = (str(P.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {p: Tokenizer.from_file(p) for p in (WORDS, BYTES)}


def odd_texts():
    make = random.Random(7)
    some = ["", None, " \n ", "Hello World, it's  FINE.", "İstanbul ΑΣ ς <|endoftext|> x<|startoftext|>y", "é é", "漢字 😀 _a_b 12,3", "word " * 3000, "x" * 5000, "a  b" * 2000]
    return some + ["".join(make.choice("abcE é'_1-\t<|>") for _ in range(80)) for _ in range(150)]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_counts_against_the_library(documents, library, path):
    texts = odd_texts()
    got = {r["doc_id"]: r for r in token_counts.token_counts(documents(list(enumerate(texts)), n_bytes="x"), path).collect()}
    for k, text in enumerate(texts):
        n = len(library[path].encode(text or "", add_special_tokens=False).ids)
        assert (got[k]["n_tokens"], got[k]["n_bytes"], got[k]["over_limit"]) == (n, len((text or "").encode()), n > 2048)


def test_long_texts_in_parts_of_batches(library):
    texts = [t or "" for t in odd_texts()] + ["some words of a long text, " * 400]
    count, cut = token_counts.counter(BYTES)
    sizes, found = token_counts.counted(pa.array(texts), count, cut, part=50, batch=300)
    assert found.tolist() == [len(library[BYTES].encode(t, add_special_tokens=False).ids) for t in texts]


def test_a_sentencepiece_model(documents):
    import sentencepiece

    texts = [t for t in odd_texts() if t is None or "\x00" not in t]
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(documents(list(enumerate(texts))), PIECES).collect()}
    assert got == {k: len(model.encode(t or "")) for k, t in enumerate(texts)}


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_ids_against_the_library(library, path):
    tokens = WordTokens.of(path)
    assert tokens.known == (path == WORDS)
    for text in odd_texts():
        assert np.frombuffer(tokens.ids((text or "").encode()), "<u4").tolist() == library[path].encode(text or "", add_special_tokens=False).ids


def checked(rows, capacity):
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(documents, library):
    texts = [*odd_texts(), "b " * 9000, "b " * 9000]
    rows = packing.pack(documents([*enumerate(texts), (3, texts[3]), (None, "z")], salt="x", rank="y", sequence_id="z"), WORDS, capacity=256).collect()
    for k, text in enumerate(texts):
        ids = [*library[WORDS].encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["piece"])
        if k == 3:
            own = own[: len(own) // 2] if len(own) > 1 else own
        assert [(r["start"], r["length"]) for r in own][:1] == [(0, min(256, len(ids)))] and own[-1]["start"] + own[-1]["length"] == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in own)
    total = sum(r["length"] for r in rows)
    assert checked(rows, 256) <= -(-total // 256) + 2 and packing.pack(documents([]), WORDS).collect() == []


def used(planned, histogram, capacity):
    """Sequences of a plan that holds exactly the histogram."""
    found: dict[int, int] = {}
    for pattern, times in planned:
        assert sum(pattern) <= capacity
        for n in pattern:
            found[n] = found.get(n, 0) + times
    assert found == {n: c for n, c in histogram.items() if c}
    return packing.sequences(planned)


def test_configurations_beat_best_fit_where_it_goes_wrong():
    histogram = {2058: 60, 1044: 60, 1034: 60, 1004: 120}
    assert used(packing.best_fit(dict(histogram), packing.Gaps(4096)), histogram, 4096) == 110
    assert used(packing.plan(histogram, 4096), histogram, 4096) <= 94  # 90 is best


def test_plans_of_broad_and_odd_histograms():
    make = np.random.default_rng(1)
    broad = dict(zip(*(x.tolist() for x in np.unique(make.integers(30, 230, 5000), return_counts=True)), strict=True))
    for histogram in (broad, {}, {5: 3}, {256: 7, 1: 1}, {n: 1 for n in range(1, 257)}):
        total = sum(n * c for n, c in histogram.items())
        assert used(packing.plan(histogram, 256), histogram, 256) <= -(-total // 256) * 1.04 + 1


def test_the_program_alone_reaches_the_bound_on_lengths_of_texts():
    lengths = np.minimum(4096, np.exp(np.random.default_rng(1).normal(5.5, 1.2, 50_000)).astype(int) + 1)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    assert used(packing.by_configurations(histogram, 4096), histogram, 4096) <= -(-int(lengths.sum()) // 4096) + 1


def test_tasks_of_other_operators_drop_the_cache_of_words():
    from tessera.llm import common, word_tokens

    path = str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    words = word_tokens.WordTokens.of(path)
    assert words.ids(b"some words") and list(common.frugal(lambda batches: batches, "words")(iter([1]))) == [1] and word_tokens._made
    assert list(common.frugal(lambda batches: batches)(iter([1]))) == [1] and not word_tokens._made
    assert word_tokens.WordTokens.of(path).ids(b"some words") == words.ids(b"some words")

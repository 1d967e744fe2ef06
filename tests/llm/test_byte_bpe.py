"""Ids against tiktoken, and the decoded bytes against the texts."""

import base64
import hashlib
import random

import pytest

from tessera.llm import byte_bpe

P = pytest.importorskip("public_tokenizers")
RANKS = str(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    make = random.Random(3)
    some = ["", None, " ", "\n\n  a", "it's <|endoftext|> 12345 naïve 漢字かな 😀‍", "a" * 3000, "-" * 1001, " " * 777 + "x", "ab" * 500, "\x00\x01퟿"]
    some += ["".join(make.choice("abcdeé ' 1\t") for _ in range(60)) for _ in range(80)]
    return some + ["".join(make.choice("etaoin") for _ in range(n)) for n in (199, 200, 201, 202, 400)]


def test_against_the_library(documents, library):
    texts = odd_texts()
    got = {r["doc_id"]: r for r in byte_bpe.round_trip(documents(list(enumerate(texts)), ids="x", word="y"), RANKS, P.PATTERN).collect()}
    for k, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_repeats_null_ids_and_an_empty_table(documents):
    rows = byte_bpe.round_trip(documents([(None, "a"), (1, "a"), (1, "a")]), RANKS, P.PATTERN).collect()
    assert len(rows) == 3 and len({r["ids_sha256"] for r in rows}) == 1
    assert byte_bpe.round_trip(documents([]), RANKS, P.PATTERN).collect() == []


def test_a_second_pattern_has_its_own_words():
    one, two = byte_bpe.Bpe.of(RANKS, P.PATTERN), byte_bpe.Bpe.of(RANKS, r"\S|\s")
    assert one is not two and one.texts([b"hello"])[0][0][1] == 1 and two.texts([b"hello"])[0][0][1] == 5


def test_words_that_come_again_are_contracted_once_when_the_cache_is_renewed(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHED", 8)
    bpe, met = byte_bpe.Bpe(RANKS, P.PATTERN), []
    encode = bpe.encode
    monkeypatch.setattr(bpe, "encode", lambda words: (met.extend(words), encode(words)))
    for k in range(40):
        texts = [f"frequent frequently q{k}x z{k}y".encode()]
        assert b"".join(w[2] for w in bpe.texts(texts)[0]) == texts[0] and len(bpe.seen) + len(bpe.older) < 40
    assert met.count("frequent") == met.count(" frequently") == 1


def test_ids_stay_in_order_where_the_aggregation_takes_rows_in_another(monkeypatch, library):
    words = ["uncharacteristically", "zqxjkv", "a", " " * 33, "aaaabaaaab", "naïveté", "x" * 300]
    monkeypatch.setattr(byte_bpe, "DECODE", byte_bpe.DECODE.replace("order by word, pos", "order by word, pos desc"))
    assert "pos desc" in byte_bpe.DECODE
    bpe = byte_bpe.Bpe(RANKS, P.PATTERN)
    bpe.encode(words)
    for word in words:
        ids = library.encode_ordinary(word)
        assert bpe.seen[word] == ("".join(f" {i}" for i in ids).encode(), len(ids), word.encode())

import hashlib
import random
from collections import Counter

import pytest

from tessera.llm import suffix_dedup


def expected(texts, width):
    starts = Counter(t[k : k + width] for t in texts for k in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = set()
        for k in range(len(t) - width + 1):
            if starts[t[k : k + width]] > 1:
                gone.update(range(k, k + width))
        out.append((len(gone), hashlib.sha256(bytes(b for k, b in enumerate(t) if k not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2, 2000])
def test_against_brute_force(documents, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    make = random.Random(5)
    word = lambda n: "".join(make.choice("abcd é") for _ in range(n))
    common, other = word(300), word(150)
    texts = [word(make.randrange(200)) + common[make.randrange(40) : 200 + make.randrange(100)] + word(make.randrange(100)) + other * make.randrange(3) for _ in range(25)]
    texts += [texts[0], "", "a" * 260]
    got = {r["doc_id"]: r for r in suffix_dedup.removals(documents([*enumerate(texts), (99, None)], raw="x"), width=100, gram=32).collect()}
    for k, (n, digest) in enumerate(expected([t.encode() for t in texts], 100)):
        assert (got[k]["n_removed"], got[k]["kept_sha256"]) == (n, digest)
    assert got[99]["n_bytes"] == 0


def test_kept_texts_keeps_columns(documents):
    docs = documents([(1, "x" + "ab" * 300), (2, "ñ" * 10), (3, None)], raw="r")
    got = {r["doc_id"]: r for r in suffix_dedup.kept_texts(docs, width=100, gram=32).collect()}
    assert got[1]["text"] == "x" and got[1]["n_chars"] == 1 and got[2]["text"] == "ñ" * 10 and got[2]["raw"] == "r" and got[3]["text"] == ""

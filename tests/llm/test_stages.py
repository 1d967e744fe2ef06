import random

from tessera.llm import pii, simhash


def test_redacted(documents):
    got = {r["doc_id"]: r["text"] for r in pii.redacted(documents([(1, "to é a.b@c.de, 10.0.0.1!"), (2, None), (3, "clean")])).collect()}
    assert got == {1: "to é <EMAIL>, <IP>!", 2: "", 3: "clean"}


def test_redacted_over_many_blocks(documents):
    got = pii.redacted(documents([(1, "é a@b.cd " * 700)])).first()["text"]
    assert got == "é <EMAIL> " * 700


def test_representatives(documents):
    rows = [(5, "one two three four"), (3, "ONE two three  four"), (3, "one two three four"), (None, "other words here now"), (9, "")]
    got = simhash.representatives(documents(rows)).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 3, 9]


def test_representatives_against_brute_force(documents):
    make = random.Random(3)
    texts = []
    for _ in range(40):
        base = [f"w{make.randrange(5000)}" for _ in range(make.choice([3, 6, 40, 150, 400]))]
        for _ in range(make.randrange(1, 6)):  # chains: each an edit of the one before
            texts.append(" ".join(base))
            base = list(base)
            for _ in range(make.randrange(1, 1 + max(1, len(base) // 60) * 2)):
                base[make.randrange(len(base))] = f"w{make.randrange(5000)}"
    make.shuffle(texts)
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    got = simhash.representatives(documents(list(enumerate(texts)))).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(group))


def test_stages_leave_only_the_tables_that_are_still_read(spark, documents):
    from pathlib import Path

    from tessera.llm import common, pii, simhash, suffix_dedup

    passage = " ".join(f"w{k}" for k in range(150))
    docs = documents([(k, f"{passage} mail a{k}@b{k}.org x{k}") for k in range(8)])
    root = Path(common.shared_root(spark).removeprefix("file://"))
    for stage, name, tables in ((simhash.representatives, "simhash", 1), (suffix_dedup.kept_texts, "suffixes", 2), (pii.redacted, "pii", 1)):
        before = set(root.glob(f"{name}-*"))
        made = stage(docs)
        (own,) = set(root.glob(f"{name}-*")) - before
        assert len([p for p in own.iterdir() if p.is_dir()]) == tables
        assert 0 < made.count() <= 8

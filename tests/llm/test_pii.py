import hashlib
import random
import re

from tessera.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in twice) % 10 == 0


def expected(text):
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            holds = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if holds:
                found.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_base_spans_against_brute_force(spark, documents):
    make = random.Random(5)
    texts = ["", None, "a@b.c_d@e.f", "x@y..z a@b-.c.d.", "4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (988) 555-2485 +1(2) 3", "1.2.3.4.5 256.1.1.1 0255.1.1.1"]
    texts += ["".join(make.choice("0123456789.-@ +()a_%é😀") for _ in range(50)) for _ in range(400)]
    texts += ["".join(make.choice("45 -") for _ in range(40)) for _ in range(400)]
    texts += ["1 2 " * 20_000, "9" * 50_000 + "@", "a." * 20_000 + "@" + "b." * 20_000 + "c"]
    rows = pii.personal_data(documents(list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = expected(texts[r["doc_id"]] or "")
        assert (r["base_sha256"], r["spans"]) == (hashlib.sha256(want.encode()).hexdigest(), want), texts[r["doc_id"]][:80]
        assert [r[f"n_{k}"] for k in BASE] == [want.count(k) for k in BASE]


def spans_of(rows):
    return {r["doc_id"]: r["spans"] for r in rows}


def test_contexts_of_seeds_find_unseen_identifiers(documents):
    known = [(i, f"please write to user{i}@mail.example.com now") for i in range(12)]
    texts = {20: "please write to user9999(at)mail now", 21: "the word to user99(x) 12", 22: "x user9999(at)mail"}
    rows = pii.personal_data(documents([*known, *texts.items(), (20, texts[20])])).collect()
    found = spans_of(rows)
    assert found[20] == "email:16:32" and found[21] == "" and found[22] == ""
    assert [(r["n_email"], r["n_added"]) for r in rows if r["doc_id"] == 20] == [(0, 1), (0, 1)]


def test_numbers_in_parts_are_one_instance(documents):
    known = [(i, f"a{i} call me on +1 (826) 555-40{i:02d}, b") for i in range(10)]
    rows = pii.personal_data(documents([*known, (20, "please call me on (826) 555 4081, c"), (21, "or 826 555 4081 c")])).collect()
    text = "please call me on (826) 555 4081, c"
    at = text.index("826")
    assert spans_of(rows)[20] == f"phone:{at}:{text.index(', c')}" and spans_of(rows)[21] == ""
    assert all(r["n_phone"] == 1 for r in rows if r["doc_id"] < 10)


def test_secrets_need_a_pattern_that_several_have(documents):
    make = random.Random(2)
    digest = lambda: "".join(make.choice("0123456789abcdef") for _ in range(38)) + "a1"
    known = [(i, f'w{i} set token = "{digest()}" v{i}') for i in range(8)]
    short = 'also token = "0a9f8e7d6c" here'
    rows = spans_of(pii.personal_data(documents([*known, (20, short), (21, f"commit {digest()} of x")])).collect())
    assert rows[20] == f"secret:{short.index('0a9')}:{short.index('0a9') + 10}" and rows[21] == "" and all(rows[i].startswith("secret:") for i in range(8))


def planted(n, seed):
    """Texts with numbers of two kinds under fixed words, of which the base sees a part, and numbers that are nobody's."""
    make = random.Random(seed)
    word = lambda: "".join(make.choice("abcdefgh") for _ in range(6))
    texts, hidden = [], []
    for k in range(n):
        own = f"+{make.randrange(10, 99)} {make.randrange(10**9, 10**10)}" if k % 3 else f"{make.randrange(1000, 9999)}.{make.randrange(1000, 9999)}"
        head = f"{word()} {word()} my number is "
        texts.append(f"{head}{own} {word()} year {make.randrange(1000, 9999)} {word()}")
        hidden.append(None if k % 3 else (len(head), len(head) + len(own)))
    return texts, hidden


def test_recall_and_precision_of_what_is_added(documents):
    texts, hidden = planted(300, 4)
    rows = pii.personal_data(documents(list(enumerate(texts)))).collect()
    found = {r["doc_id"]: [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x] for r in rows}
    added = sum(r["n_added"] for r in rows)
    caught = sum(h in found[k] for k, h in enumerate(hidden) if h)
    assert caught / sum(h is not None for h in hidden) >= 0.95 and caught / added >= 0.95


def test_redaction_and_its_columns(documents):
    rows = documents([(1, "mail a@b.c or 1.2.3.4!"), (1, "mail a@b.c or 1.2.3.4!"), (2, None), (None, "x")], text_key="k", found_spans="f")
    got = pii.redacted(rows)
    assert got.columns == rows.columns
    assert sorted((r["text"], r["text_key"]) for r in got.collect()) == [("", "k"), ("mail <EMAIL> or <IP>!", "k"), ("mail <EMAIL> or <IP>!", "k"), ("x", "k")]
    assert pii.redacted(documents([])).collect() == []


def test_empty_table_nulls_and_further_columns(documents):
    assert pii.personal_data(documents([])).collect() == []
    rows = pii.personal_data(documents([(None, None), (None, "a@b.c"), (1, "a@b.c"), (1, "a@b.c")], row="x", spans="y", t="z")).collect()
    assert sorted(r["n_email"] for r in rows) == [0, 1, 1, 1]

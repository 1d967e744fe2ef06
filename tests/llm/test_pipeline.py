"""The pipeline over the smallest tables: each stage against brute force on its own input."""

import gc
import time
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm import common, suffix_dedup

DATA = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after each stage."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    scratch = corpus_pipeline.Scratch(spark, "test")
    for _, stage in corpus_pipeline.STAGES:
        made = scratch.keep(stage(spark, docs, DATA))
        out.append((docs, made))
        docs = made
    return out


def test_stages_keep_the_columns_of_documents(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "pii", "best_fit_packing"]
    for before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_toxic_documents_go_and_most_others_stay(stages):
    before, after = stages[0]
    assert 0.9 * before.count() <= after.count() <= before.count() and after.exceptAll(before).count() == 0


def test_one_of_each_group_of_near_copies_stays(stages):
    before, after = stages[1]
    rows = sorted((r["doc_id"], shingles(r["text"])) for r in before.collect())
    least = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, a in rows:
            for j, b in rows:
                if least[j] < least[i] and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                    least[i], changed = least[j], True
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(least.values()))


def test_repeated_passages_go(stages):
    before, after = stages[2]
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in before.collect()}
    found = Counter(t[i : i + 400] for t in texts.values() for i in range(len(t) - 399))
    left = {r["doc_id"]: r["text"] for r in after.collect()}
    assert set(left) == set(texts)
    for key, text in texts.items():
        covered = bytearray(len(text))
        for i in range(len(text) - 399):
            if found[text[i : i + 400]] > 1:
                covered[i : i + 400] = b"\1" * 400
        spans = suffix_dedup.united([{"a": i, "b": i + 1} for i, c in enumerate(covered) if c], None, len(text))
        parts = zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(text)], strict=True)
        assert left[key] == "".join(text[a:b].decode("utf-8", "ignore") for a, b in parts)


def test_personal_data_is_masked(stages):
    before, after = stages[3]
    told = {r["doc_id"]: r["text"] for r in after.collect()}
    for r in before.collect():
        assert "@mail" not in told[r["doc_id"]] and (told[r["doc_id"]] == (r["text"] or "") or "<" in told[r["doc_id"]])


def test_the_rest_is_packed(spark, stages):
    from tokenizers import Tokenizer

    before, after = stages[4]
    library = Tokenizer.from_file(corpus_pipeline.vocabulary("word_bpe_49k.json"))
    want = Counter()
    for r in before.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            piece = b"".join(i.to_bytes(4, "little") for i in ids[at : at + 4096])
            want[r["doc_id"], k, at, len(piece) // 4, zlib.crc32(piece)] += 1
    rows = after.collect()
    assert Counter(tuple(r[:5]) for r in rows) == want
    ends: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    total = sum(r["length"] for r in rows)
    assert max(ends.values()) <= 4096 and len(ends) <= -(-total // 4096) + 1


def test_a_run_gives_what_its_stages_give(spark, stages):
    packed = corpus_pipeline.run(spark, DATA)
    assert packed.columns == stages[-1][1].columns
    assert sorted(map(tuple, packed.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, stages[-1][1].select("doc_id", "piece", "ids_crc32").collect()))


def test_each_stage_begins_in_executors_that_have_collected_their_garbage(spark, documents):
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    used = lambda: runtime.totalMemory() - runtime.freeMemory()
    begun = corpus_pipeline.after_others(lambda spark, docs, sf_dir: (docs, used()))
    assert all(stage.__code__ is begun.__code__ for _, stage in corpus_pipeline.STAGES)
    filled = [spark.sparkContext._gateway.new_array(spark._jvm.byte, 64 << 20) for _ in range(2)]
    del filled
    gc.collect()
    before, docs = used(), documents([])
    assert begun(spark, docs, DATA)[0] is docs and begun(spark, docs, DATA)[1] < before - (64 << 20)


def test_long_groups_hand_their_memory_back_and_short_ones_do_not(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "released", lambda: calls.append(1))
    assert common.frugal_group(lambda group: group + 1)(1) == 2 and not calls
    assert common.frugal_group(lambda group: time.sleep(common.WORTH) or group)(1) == 1 and calls == [1]
    with pytest.raises(ZeroDivisionError):
        common.frugal_group(lambda group: time.sleep(common.WORTH) or 1 / group)(0)
    assert len(calls) == 2

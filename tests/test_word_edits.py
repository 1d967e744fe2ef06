"""Word edits against a plain table, and their order, ties and notes."""

import time
import tracemalloc
from difflib import SequenceMatcher

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators import evaluation, word_edits
from tessera.plans import scoring


def plain_path(ref, hyp):
    table = [[max(i, j) if not i or not j else 0 for j in range(len(hyp) + 1)] for i in range(len(ref) + 1)]
    for i, r in enumerate(ref, 1):
        for j, h in enumerate(hyp, 1):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (r != h))
    i, j, out = len(ref), len(hyp), []
    while i or j:
        if i and table[i][j] == table[i - 1][j] + 1:
            i -= 1
            out.append(("deletion", ref[i], ""))
        elif j and table[i][j] == table[i][j - 1] + 1:
            j -= 1
            out.append(("insertion", "", hyp[j]))
        else:
            i, j = i - 1, j - 1
            if ref[i] != hyp[j]:
                out.append(("substitution", ref[i], hyp[j]))
    return out[::-1]


words = st.lists(st.sampled_from("abcd"), max_size=14)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=9))
def test_counts_and_paths(pairs):
    paths, counts = word_edits.edit_paths(pairs), word_edits.edit_counts(pairs)
    for (ref, hyp), path, row in zip(pairs, paths, counts.tolist(), strict=True):
        assert path == plain_path(ref, hyp)
        kinds = [k for k, _, _ in path]
        assert row[1:] == [kinds.count(k) for k in word_edits.KINDS] and sum(row[:3]) == len(ref)


def test_a_swap_is_a_deletion_and_an_insertion():
    assert word_edits.edit_counts([("a b".split(), "b a".split())]).tolist() == [[1, 0, 1, 1]]


def test_pairs_larger_than_a_block(monkeypatch):
    monkeypatch.setattr(word_edits, "CELLS", 50)
    pairs = [(list("abcabcabc" * n), list("acbacb" * n)) for n in (0, 1, 2, 5)]
    assert word_edits.edit_paths(pairs) == [plain_path(*p) for p in pairs]


def test_rates_notes_and_order(spark):
    rows = spark.createDataFrame([(0, "पयले, a b", "पहिले b b"), (1, "पयले c", "पहिले x"), (2, "!!", "q"), (3, None, None)], "seq long, reference string, prediction string")
    samples = evaluation.sample_scores(rows, ["seq"]).orderBy("seq").collect()
    assert [(r["substitutions"], r["reference_words"], r["wer"]) for r in samples] == [(2, 3, 2 / 3), (2, 2, 1.0), (0, 0, None), (0, 0, None)]
    plain = [F.regexp_replace(F.coalesce(c, F.lit("")), ",", "") for c in ("reference", "prediction")]
    pairs = evaluation.in_input_order(word_edits.edit_pairs(word_edits.edits_in_order(rows.filter("seq < 2"), *plain, F.col("seq")))).orderBy("rank").collect()
    assert [(p["reference_word"], p["count"]) for p in pairs] == [("पयले", 2), ("a", 1), ("c", 1)]
    assert pairs[0]["similarity"] == round(SequenceMatcher(None, "पयले", "पहिले").ratio(), 2) and pairs[0]["heuristic_note"].startswith("similar")
    none = evaluation.word_edits.corpus_rates(samples_of(spark)).collect()
    assert [(r["evaluated_samples"], r["reference_words"], r["wer"], r["substitutions"]) for r in none] == [(0, 0, None, None)]


def samples_of(spark):
    return evaluation.sample_scores(spark.createDataFrame([], "reference string, prediction string, k long"), ["k"])


def test_runs_are_scored_once(spark):
    runs = scoring.two_runs(spark, "/root/testdata/sf0.001")
    assert not [1 for run in runs for rows in run if "MapInArrow" in rows._jdf.queryExecution().optimizedPlan().toString()]
    differences, label = evaluation.comparison(*runs)
    told = {r["metric"]: (r["a"], r["b"]) for r in differences.collect()}
    assert label == "PILOT" and set(told) == set(evaluation.METRICS)
    assert told["evaluated_samples"] == (runs[0][1].count(), runs[1][1].count()) and told["insertions"][1] == 0 < told["insertions"][0]


def test_character_edits_of_a_text_and_its_own_beginning(spark):
    small = [("", ""), ("ab c", "ab"), ("ab", "ab c"), ("", "ab"), ("ab", ""), ("ab", "ab"), ("bab", "ab"), ("é à", "é"), ("ea", "é")]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(small)], "k long, reference string, prediction string")
    found = {r["k"]: r["char_edits"] for r in evaluation.sample_scores(rows, ["k"]).collect()}
    assert [found[k] for k in range(len(small))] == [0, 2, 2, 2, 2, 0, 1, 2, 2]
    began = time.monotonic()
    long = spark.createDataFrame([("x" * 200_000, "x" * 199_000)], "reference string, prediction string")
    assert [r["char_edits"] for r in evaluation.sample_scores(long, []).collect()] == [1000]
    assert time.monotonic() - began < 15  # a table of all cells takes minutes


class Captured:
    """In place of a table: keeps the function that would run over its batches."""

    schema = StructType()

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def peak_of(run, n):
    """(rows, peak MB of Python's own memory) of a batch of n rows with 40 words on both sides."""
    ref = [" ".join(f"word{(k * 7 + i) % 900}" for i in range(40)) for k in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(ref), pa.array([r.replace("word1", "ward1") for r in ref]), pa.array(range(n), pa.int64())], ["r", "h", "k"])
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in run(iter([batch])))
        return rows, tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_memory_of_paths_does_not_grow_with_a_batch(spark):
    run = word_edits.edits_in_order(Captured(), *map(F.col, "rhk")).run
    (_, small), (many, large) = peak_of(run, 2_500), peak_of(run, 10_000)
    assert many > 10_000 and large < 1.5 * small


def test_gold_metrics_align_once(spark):
    plan = scoring.gold_scores(spark, "/root/testdata/sf0.001").metrics._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_slices_are_the_whole_batch(monkeypatch):
    monkeypatch.setattr(word_edits, "SLICE", 200)
    texts = ["a b", None, "", "x" * 500, "c", "c", "d"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(texts[::-1]), pa.array(range(len(texts)))], ["r", "h", "k"])
    parts = list(word_edits.slices(batch))
    assert len(parts) > 3 and pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert not list(word_edits.slices(batch.slice(0, 0)))


def test_memory_of_counts_does_not_grow_with_a_batch(spark):
    run = word_edits.counted(Captured(), F.col("r"), F.col("h"), ["k"]).run
    (_, small), (many, large) = peak_of(run, 2_500), peak_of(run, 10_000)
    assert many == 10_000 and large < 1.5 * small

"""Chunks, seams, groups, alignment and pages against direct computation."""

import itertools
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import chunks, ctc, html_units

RATE = 16_000


def tone(seconds):
    return (0.5 * np.sin(np.arange(int(seconds * RATE)) * 0.05)).astype(np.float32)


def test_cuts_lie_in_pauses():
    signal = tone(70)
    for at in (25, 52):
        signal[int(at * RATE) : int((at + 0.4) * RATE)] = 0
    found = chunks.cuts(signal, RATE, chunks.ChunkSettings())
    assert [b for _, b in found[:-1]] == [a for a, _ in found[1:]] and found[0][0] == 0 and found[-1][1] == len(signal)
    assert 25 <= found[0][1] / RATE <= 25.4 and 52 <= found[1][1] / RATE <= 52.4
    shared = chunks.cuts(signal, RATE, chunks.ChunkSettings(overlap_sec=2))
    assert all(b - a == 2 * RATE for (_, b), (a, _) in itertools.pairwise(shared))
    assert chunks.cuts(np.zeros(0, np.float32), RATE, chunks.ChunkSettings()) == []


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 400), st.floats(0.05, 0.5), st.floats(0, 0.5), st.floats(0, 0.04))
def test_cuts_cover_a_signal(size, target, more, overlap):
    found = chunks.cuts(np.ones(size, np.float32), 100, chunks.ChunkSettings(target, target + more, min(overlap, target / 2)))
    assert not size or (found[0][0] == 0 and found[-1][1] == size)
    assert all(a < b <= a2 + len(range(size)) and a2 <= b for (a, b), (a2, _) in itertools.pairwise(found))


def test_settings():
    assert chunks.ChunkSettings.resolved({"ASR_CHUNK_SEC": "5"}, max_sec=9.0) == chunks.ChunkSettings(5.0, 9.0, 0.0)
    for bad in ((0, 1, 0), (3, 2, 0), (2, 3, 2), (2, 3, -1)):
        with pytest.raises(ValueError):
            chunks.ChunkSettings(*bad)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_longest_common_run(left, right):
    best = SequenceMatcher(None, left, right, autojunk=False).find_longest_match()
    assert chunks.longest_common_run(left, right) == (best.a, best.b, best.size) or not best.size


def test_stitching():
    assert chunks.stitched([" a b", "c ", None, "d"], False) == "a b c d"
    assert chunks.stitched(["a b c d x", "y c d e"], True) == "a b c d e"
    assert chunks.stitched(["a b", "b c"], True) == "a b b c"


def test_groups_of_units(spark):
    rows = [(0, 1.0, 6.0), (1, 7.0, 12.0), (2, 13.0, 30.0), (3, 30.4, 50.0), (4, 51.0, 55.0)]
    units = spark.createDataFrame([(1, *r) for r in rows] + [(2, 0, 0.0, 99.0)], "k int, i int, start double, end double")
    found = chunks.unit_groups(units, "k", "i", 12.0).orderBy("k", "place").collect()
    assert [(r["first"], r["last"], r["start"], r["end"]) for r in found] == [(0, 1, 1.0, 12.5), (2, 2, 12.5, 30.2), (3, 3, 30.2, 50.5), (4, 4, 50.5, 55.0), (0, 0, 0.0, 99.0)]


def best_score(frames, tokens, blank):
    """The best score over all paths, by trying them: frames outside the text count as their best symbol."""
    states = [blank if k % 2 == 0 else tokens[k // 2] for k in range(2 * len(tokens) + 1)]
    worth = {}
    for t, frame in enumerate(frames):
        now = {"before": sum(f.max() for f in frames[: t + 1])}
        for k, symbol in enumerate(states):
            ways = [worth.get(k), worth.get(k - 1)]
            if k > 1 and k % 2 and symbol != states[k - 2]:
                ways.append(worth.get(k - 2))
            if k < 2:
                ways.append(sum(f.max() for f in frames[:t]))
            ways = [w for w in ways if w is not None]
            if ways:
                now[k] = max(ways) + frame[symbol]
        ends = [worth.get(len(states) - 1), worth.get(len(states) - 2), worth.get("after")]
        ends = [e for e in ends if e is not None]
        if ends:
            now["after"] = max(ends) + frame.max()
        worth = now
    return max(x for x in (worth.get(len(states) - 1), worth.get(len(states) - 2), worth.get("after")) if x is not None)


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 4), st.integers(6, 14))
def test_viterbi_finds_the_best_path(seed, n, size):
    make = np.random.default_rng(seed)
    frames, tokens = np.log(make.dirichlet(np.ones(5), size)), make.integers(0, 4, n).tolist()
    if size < n + sum(a == b for a, b in itertools.pairwise(tokens)):
        return
    spans = ctc.viterbi(frames, tokens, 4)
    assert all(a <= b for a, b in spans) and all(b < a2 for (_, b), (a2, _) in itertools.pairwise(spans))
    score = sum(f.max() for f in frames[: spans[0][0]])
    inside = sum(frames[a : b + 1, k].sum() for (a, b), k in zip(spans, tokens, strict=True))
    between = sum(frames[b + 1 : a, 4].sum() for (_, b), (a, _) in itertools.pairwise(spans))
    # The edges may be blanks or outside of the text: outside is never worse.
    score += inside + between + sum(f.max() for f in frames[spans[-1][1] + 1 :])
    assert score == pytest.approx(best_score(frames, tokens, 4))


def likely(*symbols):
    frames = np.full((len(symbols), 6), 0.02)
    frames[np.arange(len(symbols)), list(symbols)] = 0.9
    return np.log(frames)


def test_viterbi_cases(spark):
    assert ctc.viterbi(likely(5, 0, 5, 0, 5), [0, 0], 5) == [(1, 1), (3, 3)]
    with pytest.raises(ValueError):
        ctc.viterbi(likely(0, 0), [], 5)
    with pytest.raises(ValueError):
        ctc.viterbi(likely(0, 0), [0, 0], 5)
    rows = spark.createDataFrame([(1, likely(5, 1, 1, 2).tolist(), [1, 2]), (2, likely(1).tolist(), [1, 1]), (3, None, None)], "k int, log_probs array<array<double>>, tokens array<int>")
    found = {r["k"]: r for r in ctc.aligned(rows, "k", 5).collect()}
    assert [tuple(x) for x in found[1]["spans"]] == [(1, 2), (3, 3)] and found[2]["error"].startswith("audio too short") and found[3]["error"]
    assert rows.filter("k = 1").select(ctc.greedy_ids(F.col("log_probs"), 5).alias("g")).first()["g"] == [1, 2]


PAGE = """<body class="ignored"><div class="ChapterContent_chapter"><div class="c__s"><span class="c__heading">A <b>head</b></span></div><div class="c__r"><span class="c__content">no</span></div>
<span class="c__verse v1" data-usfm="X.1.1"><span class="c__label">1</span><span class="c__content">one</span><span class="c__note"><span class="c__body">note</span></span><span class="c__content">two<br>three</span></span>
<span class="c__verse" data-usfm="X.1.1"><span class="c__content">  &amp; four</span></span><span class="c__verse" data-usfm="X.1.2"><span class="c__content"> </span></span><p><span class="c__verse" data-usfm="X.1.3"><span class="c__content">open</div>"""


def test_pages():
    got = html_units.units_of(PAGE.replace('<body class="ignored">', ""))
    assert got == [{"kind": "heading", "ref": "", "text": "A head"}, {"kind": "verse", "ref": "X.1.1", "text": "one two three & four"}, {"kind": "verse", "ref": "X.1.3", "text": "open"}]
    assert html_units.units_of(None) == []

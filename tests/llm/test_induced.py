"""Repeated windows against counting them, with queues far smaller than the text."""

import os
import random
import tempfile
from collections import Counter

import numpy as np
import pytest

from tessera.llm import induced


def counted(strings, width):
    found = Counter(x[i : i + width] for x in strings for i in range(len(x) - width + 1))
    return [[found[x[i : i + width]] > 1 for i in range(len(x) - width + 1)] for x in strings]


@pytest.mark.parametrize("held", [1, 3, 40, 10**6])
def test_against_counting(held):
    make = random.Random(3)
    for k in range(60):
        width = make.choice([1, 2, 3, 5, 8])
        strings = [bytes(make.choice(b"ab" if k % 3 else b"abcdef") for _ in range(make.randrange(0, 40))) for _ in range(make.randrange(1, 7))]
        assert [x.tolist() for x in induced.repeated_windows(strings, width, held)] == counted(strings, width)
    assert induced.repeated_windows([], 3) == []


def test_a_text_many_times_larger_than_the_queues_memory(monkeypatch):
    make = random.Random(5)
    base = bytes(make.choice(b"abcd ") for _ in range(60_000))
    strings = [base[:30_000], base[20_000:], bytes(make.choice(b"abcd") for _ in range(20_000)) + base[100:900]]
    folder, spilled = tempfile.mkdtemp(), []
    monkeypatch.setattr(tempfile, "tempdir", folder)
    spill = induced.Queues.spill
    monkeypatch.setattr(induced.Queues, "spill", lambda self: (spilled.append(self.held), spill(self)))
    got = induced.repeated_windows(strings, 400, held=500)
    assert [x.tolist() for x in got] == counted(strings, 400)
    assert len(spilled) > 100 and max(spilled) <= 500 and os.listdir(folder) == []


def test_segments_come_back_in_order_from_both_ends():
    queue = induced.Queues(2, 4)
    for k in range(25):
        queue.put(1, np.arange(3 * k, 3 * k + 3), np.zeros(3, np.int32))
    ends = [queue.take(1, last=True)[0].tolist() for _ in range(3)]
    assert ends[0][-1] == 74 and ends[1][-1] == ends[0][0] - 1 and queue.held <= 4
    rest = []
    while (one := queue.take(1)) is not None:
        rest += one[0].tolist()
    assert rest == list(range(ends[2][0])) and queue.take(0) is None
    queue.close()

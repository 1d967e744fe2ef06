"""External induced suffix sorting with common-prefix lengths, for finding the windows of a text that occur twice.

The suffixes at local minima of the text (left-most S type) are named and ordered by the recursion on the names, by doubling, as
deep as `width` asks. All other suffixes are induced: queues, one for each first letter, hold (position, common prefix with the
queue's entry before) in sorted order; a scan takes the queues in the order of their letters and puts the predecessor of each entry that
it takes at the end of its own letter's queue, first for the L types upwards, then for the S types downwards. A predecessor's common
prefix is one more than the least on the way from the last one put into the same queue, a range minimum; so prefix lengths come with the
entries and the text is not looked at again but for the seams of L and S types. Queues over their share of memory go to files in a
temporary folder, in segments of bounded size, and are read back segment by segment when the scan comes to their letter; the folder goes with its owner, after an exception too.
The shard's text, types and names stay in memory (about 60 bytes a byte of text), so callers bound a shard; the queues are what may be far larger than their memory. A scan never needs the sorted array as a whole: neighbours whose
common prefix reaches width are marked as they pass.
"""

from __future__ import annotations

import os
import tempfile
from collections import deque

import numpy as np

#: Entries that the queues hold in memory before they go to files.
HELD = 8_000_000
NONE = np.iinfo(np.int32).max


class Queues:
    """A first-in-first-out queue of (position, prefix) segments for each letter; all together hold at most `most` entries in memory, the rest is in files.

    What a scan puts in comes in sorted order for each letter, so that the queues, taken by letter, are the priority queue of the induction. A segment is what is
    put in or read back at once, `most` entries at most, so that taking from a long queue holds no more than putting into it.
    """

    def __init__(self, letters: int, most: int):
        self.segments: list[deque] = [deque() for _ in range(letters)]
        self.most, self.held, self.files, self.folder = max(1, most), 0, 0, None

    def put(self, letter: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        for at in range(0, len(positions), self.most):
            part = (positions[at : at + self.most], prefixes[at : at + self.most])
            if self.held + len(part[0]) > self.most:
                self.spill()
            self.segments[letter].append(part)
            self.held += len(part[0])

    def spill(self) -> None:
        """Moves all that is in memory to files; neighbours of a letter go into one file, up to `most` entries."""
        self.folder = self.folder or tempfile.TemporaryDirectory(prefix="induced-")
        for segments in self.segments:
            kept: deque = deque()
            together: list[np.ndarray] = []

            def close(kept: deque = kept, together: list[np.ndarray] = together) -> None:
                if together:
                    path = f"{self.folder.name}/{self.files}"
                    self.files += 1
                    np.concatenate(together).tofile(path)
                    kept.append(path)
                    together.clear()

            for one in segments:
                if isinstance(one, str):
                    close()
                    kept.append(one)
                else:
                    together.append(np.stack([one[0], one[1].astype(np.int64)], 1))
            close()
            segments.clear()
            segments.extend(kept)
        self.held = 0

    def take(self, letter: int, last: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """The first segment of the letter's queue, or the last one; neighbours in memory, which are bounded together, come at once."""
        segments = self.segments[letter]
        if not segments:
            return None
        one = segments.pop() if last else segments.popleft()
        if not isinstance(one, str):
            together = [one]
            while segments and not isinstance(segments[-1 if last else 0], str):
                together.append(segments.pop() if last else segments.popleft())
            together = together[::-1] if last else together
            self.held -= sum(len(x[0]) for x in together)
            return (np.concatenate([x[0] for x in together]), np.concatenate([x[1] for x in together])) if len(together) > 1 else one
        rows = np.fromfile(one, np.int64).reshape(-1, 2)
        os.remove(one)
        return rows[:, 0], rows[:, 1].astype(np.int32)

    def close(self) -> None:
        if self.folder:
            self.folder.cleanup()


class Least:
    """Range minima over an array (sparse table)."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least of each first..last; NONE where that is empty."""
        out = np.full(len(first), NONE, np.int32)
        size = last - first + 1
        level = np.frexp(np.maximum(size, 1).astype(float))[1] - 1
        for k in np.unique(level[size > 0]):
            who = np.flatnonzero((level == k) & (size > 0))
            out[who] = np.minimum(self.levels[k][first[who]], self.levels[k][last[who] - (1 << int(k)) + 1])
        return out


def s_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last letter is the only least one."""
    step = np.sign(np.diff(text.astype(np.int32)))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    following = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(step, -1)[following] > 0, True)


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Length of the common prefix of the suffixes a and b, width at most; the text ends in width letters that differ from all others'."""
    out, live = np.zeros(len(a), np.int32), np.arange(len(a))
    for k in range(0, width, 8):
        if not len(live):
            break
        same = np.stack([text[a[live] + k + j] == text[b[live] + k + j] for j in range(8)], 1)
        run = np.where(same.all(1), 8, (~same).argmax(1))
        out[live] += run.astype(np.int32)
        live = live[run == 8]
    return np.minimum(out, width)


class Induction:
    def __init__(self, text: np.ndarray, width: int, held: int = HELD):
        """text: small non-negative letters, 0 at the end only; what follows is padded so that comparisons may run on."""
        self.text, self.width, self.held = text, width, held
        self.letters = int(text.max()) + 1
        self.s = s_types(text)
        self.minima = np.flatnonzero(self.s[1:] & ~self.s[:-1]) + 1
        self.padded = np.concatenate([text, np.zeros(width + 8, text.dtype)])

    def scan(self, order: np.ndarray, prefixes: np.ndarray, mark=None) -> np.ndarray:
        """The minima as the induction from order brings them, in ascending order; mark(a, b, prefix) sees all neighbours."""
        text, s = self.text, self.s
        first = np.searchsorted(text[order], np.arange(self.letters + 1))
        up, down = Queues(self.letters, self.held // 2), Queues(self.letters, self.held // 2)
        kept = Queues(self.letters, self.held // 2)
        tail = [-1] * self.letters
        out: list[np.ndarray] = []

        def sends(into: Queues, started: np.ndarray, least: np.ndarray, where: np.ndarray, prefix: np.ndarray, goes: np.ndarray) -> None:
            """Puts the predecessors of where[goes] into their letters' queues."""
            table, n = Least(prefix), len(where)
            at = np.flatnonzero(goes)
            letter = text[where[at] - 1].astype(np.int64)
            by = np.argsort(letter, kind="stable")
            at, letter = at[by], letter[by]
            cut = np.flatnonzero(np.diff(letter, prepend=-1))
            before = np.concatenate([[0], at[:-1] + 1]) if len(at) else at
            if len(at):
                before[cut] = 0
            found = table.of(before, at)
            if len(at):
                found[cut] = np.minimum(found[cut], least[letter[cut]])
            least[:] = np.minimum(least, prefix.min())
            ends = np.append(cut[1:], len(at)) - 1 if len(at) else cut
            if len(at):
                least[letter[ends]] = table.of(at[ends] + 1, np.full(len(ends), n - 1))
            found = np.minimum(found.astype(np.int64) + 1, self.width).astype(np.int32)
            for a, b in zip(cut, ends + 1, strict=True):
                d = int(letter[a])
                if not started[d]:
                    found[a], started[d] = 0, True
                into.put(d, where[at[a:b]] - 1, found[a:b])

        def seam(a: int, b: int) -> int:
            return int(common(self.padded, np.array([a]), np.array([b]), self.width)[0])

        started, least = np.zeros(self.letters, bool), np.full(self.letters, NONE, np.int32)
        for c in range(self.letters):
            fresh = True
            while (got := up.take(c)) is not None:
                where, prefix = got
                if fresh:
                    prefix = prefix.copy()
                    prefix[0], fresh = 0, False
                kept.put(c, where, prefix)
                tail[c] = int(where[-1])
                sends(up, started, least, where, prefix, (where > 0) & (text[where - 1] >= c))
            own = order[first[c] : first[c + 1]]
            if len(own):
                prefix = prefixes[first[c] : first[c + 1]].copy()
                prefix[0] = seam(tail[c], int(own[0])) if tail[c] >= 0 else 0
                sends(up, started, least, own, prefix, own > 0)
        up.close()

        started, least = np.zeros(self.letters, bool), np.full(self.letters, NONE, np.int32)
        for c in range(self.letters - 1, -1, -1):
            last = -1
            while (got := down.take(c)) is not None:
                where, prefix = got
                if last < 0:
                    prefix = prefix.copy()
                    prefix[0] = 0
                if mark is not None:
                    mark(np.append(last if last >= 0 else where[0], where[:-1]), where, prefix)
                last = int(where[-1])
                if mark is None:
                    own = where[(where > 0) & ~s[where - 1]]
                    out.append(own)
                sends(down, started, least, where, prefix, (where > 0) & (text[where - 1] <= c))
            if c == 0 and mark is None:
                out.append(np.array([len(text) - 1]))
            carry = None  # the common prefix of the last entry that was taken with the one before it
            while (got := kept.take(c, last=True)) is not None:
                where, prefix = got
                back = where[::-1]
                shifted = np.append(0, prefix[:0:-1]).astype(np.int32)
                shifted[0] = carry if carry is not None else seam(last, int(back[0])) if last >= 0 else 0
                if mark is not None:
                    mark(np.append(last if last >= 0 else back[0], back[:-1]), back, shifted)
                sends(down, started, least, back, shifted, (back > 0) & (text[back - 1] < c))
                last, carry = int(back[-1]), int(prefix[0])
        down.close()
        kept.close()
        return np.concatenate(out)[::-1] if out else np.zeros(0, np.int64)

    def ordered_minima(self) -> np.ndarray:
        """The suffixes at the minima in the order of their first width letters."""
        by_letter = self.minima[np.argsort(self.text[self.minima], kind="stable")]
        order = self.scan(by_letter, np.zeros(len(by_letter), np.int32))
        place = np.full(len(self.text), -1)
        place[self.minima] = np.arange(len(self.minima))
        ends = np.append(self.minima[1:], self.minima[-1])
        a, b = order[:-1], order[1:]
        size = ends[place[order]] - order + 1
        same = size[:-1] == size[1:]
        live = np.flatnonzero(same)
        k = 0
        while len(live):
            live = live[k < size[live]]
            differ = self.padded[a[live] + k] != self.padded[b[live] + k]
            same[live[differ]] = False
            live, k = live[~differ], k + 1
        name = np.empty(len(order), np.int64)
        name[place[order]] = np.cumsum(np.append(0, ~same))
        step = 1
        while step < self.width and name.max() + 1 < len(name):
            after = np.append(name[step:], np.full(min(step, len(name)), -1))[: len(name)] + 1
            key = name * (len(name) + 1) + after
            by = np.argsort(key, kind="stable")
            fresh = np.append(0, np.diff(key[by]) != 0)
            name[by] = np.cumsum(fresh)
            step *= 2
        return self.minima[np.argsort(name, kind="stable")]

    def repeated(self) -> np.ndarray:
        """Whether the width letters from each position occur at another position too."""
        found = np.zeros(len(self.text), bool)
        if len(self.minima) == 0:
            return found
        order = self.ordered_minima()
        prefixes = np.append(0, common(self.padded, order[:-1], order[1:], self.width)).astype(np.int32)

        def mark(a: np.ndarray, b: np.ndarray, prefix: np.ndarray) -> None:
            far = prefix >= self.width
            found[a[far]] = found[b[far]] = True

        self.scan(order, prefixes, mark)
        return found


def repeated_windows(strings: list[bytes], width: int, held: int = HELD) -> list[np.ndarray]:
    """For each string, whether the window of width bytes at each place occurs elsewhere, in this string or another."""
    if not strings:
        return []
    parts = [np.frombuffer(x, np.uint8).astype(np.uint16) + 2 for x in strings]
    text = np.concatenate([y for p in parts for y in (p, np.ones(1, np.uint16))] + [np.zeros(1, np.uint16)])
    found = Induction(text, width, held).repeated()
    out, at = [], 0
    for p in parts:
        n = max(0, len(p) - width + 1)
        out.append(found[at : at + n])
        at += len(p) + 1
    return out

"""Packing of tokenized documents into as few fixed-size sequences as possible.

Plan. The corpus enters the plan only as a histogram of piece lengths (at most `capacity` entries, whatever the corpus).
The lengths are grouped into at most CLASSES classes of about the same number of tokens, each as long as its longest member, and the configuration linear program over these
(which multisets of lengths fill a sequence, how often each) is solved by multiplicative weights: each round prices the classes by how little they are
covered, an unbounded-knapsack dynamic program over the whole capacity finds the dearest configuration, and covered classes lose weight. That finds configurations;
finer weights over these then say how often to use each, and new ones are priced in until none is dearer by TOLERANCE. The fractional solution is rounded up to whole
sequences, the most frequent first, as long as there are pieces to fill them. What is left, and the shortest pieces (SPARE of the tokens, and as many as classes are longer than their members), go by best fit, longest first, into the
tightest gaps. All of this works on (pattern, how many sequences have it), never on pieces; it takes the same time for any corpus. Best fit alone is
planned too, and taken where it needs fewer sequences.

Rows. Pieces are numbered within their length, in salted parts of LEAST_PART rows or, where that would be over PARTS parts in all, as many more as it takes,
so that no task gets one length's rows; a look-up in the plan gives sequence and offset. Tokenization runs once: its pieces are kept in the shared folder.

Null and empty texts are one piece (the end id alone); repeated rows are packed as they are, each on its own; a null id stays null;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, frugal
from .word_tokens import WordTokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of a part of one length, at least, and how many parts there are in all, about (their sizes are a small table in the driver).
LEAST_PART, PARTS = 256, 16_384
#: Classes of the linear program, steps of the weights when configurations are found and when they are weighed, how much dearer a new configuration must be, and rounds that price new ones in.
CLASSES, COARSE, FINE, TOLERANCE, ROUNDS = 64, 0.5, 0.08, 0.005, 24
#: Parts of the capacity that the dynamic program tells apart where there are more lengths than classes, and the share of tokens, in the shortest pieces, that is held back for gaps.
RESOLUTION, SPARE = 512, 0.03


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of at most capacity ids of each text; only longer texts are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = WordTokens.of(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), pc.fill_null(batch.column(1).cast(pa.large_binary()), b""), strict=True):
                ids = tokens.ids(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run, "words"), PIECES)


def best_configuration(prices: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    """How often the dearest multiset of classes whose sizes add up to room at most has each: unbounded knapsack by dynamic programming."""
    worth, take = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), "right")
    for c in range(int(sizes[0]), room + 1):
        got = prices[: fits[c]] + worth[c - sizes[: fits[c]]]
        best = int(got.argmax())
        if got[best] > worth[c - 1]:
            worth[c], take[c] = got[best], best
        else:
            worth[c] = worth[c - 1]
    out, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            out[take[c]] += 1
            c -= int(sizes[take[c]])
    return out


def weights(sizes: np.ndarray, demand: np.ndarray, room: int, step: float, pool: list[np.ndarray], find: bool) -> tuple[np.ndarray, np.ndarray]:
    """(how often to use each configuration of pool, the classes' mean prices); with find the dynamic program picks, and what it finds joins pool."""
    n = len(sizes)
    covered, target, mean = np.zeros(n), np.log(n + 1) / step**2, np.zeros(n)
    use: list[float] = [0.0] * len(pool)
    places = {c.tobytes(): k for k, c in enumerate(pool)}
    table = None if find else np.array(pool, float)
    while (open_ := covered < target).any():
        own = np.where(open_, np.exp(-step * (covered - covered[open_].min())), 0)
        prices = own / demand
        mean += prices / (prices @ sizes)
        if find:
            config = best_configuration(prices, sizes, room)
            k = places.setdefault(config.tobytes(), len(pool))
            if k == len(pool):
                pool.append(config)
                use.append(0.0)
        else:
            k = int((table @ prices).argmax())
            config = pool[k]
        has = config > 0
        times = float((demand[has] / config[has]).min())
        use[k] += times
        covered += config * times / demand
    return np.array(use) / target, mean


def solve_configurations(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, float]]:
    """(configuration, how often) so that each class (sizes ascending) is covered demand times, fractionally, with about the fewest sequences."""
    if not len(sizes):
        return []
    pool: list[np.ndarray] = []
    weights(sizes, demand, room, COARSE, pool, find=True)
    for _ in range(ROUNDS):
        use, prices = weights(sizes, demand, room, 2 * FINE, pool, find=False)
        config = best_configuration(prices, sizes, room)
        if config @ prices <= (1 + TOLERANCE) * max(c @ prices for c in pool):
            break
        pool.append(config)
    use, _ = weights(sizes, demand, room, FINE, pool, find=False)
    return [(c, float(n)) for c, n in zip(pool, use, strict=True) if n]


class Gaps:
    """Sequences that are still open, as groups with the same pattern, by room left; best(l) is the tightest that l fits."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms: list[int] = []
        self.groups: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)

    def put(self, pattern: tuple[int, ...], times: int) -> None:
        room = self.capacity - sum(pattern)
        if not self.groups[room]:
            bisect.insort(self.rooms, room)
        self.groups[room].append((pattern, times))

    def best(self, length: int) -> tuple[tuple[int, ...], int] | None:
        i = bisect.bisect_left(self.rooms, length)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        got = self.groups[room].pop()
        if not self.groups[room]:
            self.rooms.pop(i)
        return got


Planned = list[tuple[tuple[int, ...], int]]


def best_fit(left: dict[int, int], gaps: Gaps) -> Planned:
    """The plan with left {length: pieces} put into the tightest gaps, longest first, and into new sequences where none is wide enough."""
    for n in sorted(left, reverse=True):
        wanted = left[n]
        while wanted:
            got = gaps.best(n)
            if got is None:
                fill = gaps.capacity // n
                if wanted >= fill:
                    gaps.put((n,) * fill, wanted // fill)
                if wanted % fill:
                    gaps.put((n,) * (wanted % fill), 1)
                break
            pattern, times = got
            each = min((gaps.capacity - sum(pattern)) // n, -(-wanted // times))
            some = min(times, wanted // each)
            if some < times:
                gaps.put(pattern, times - some)
            gaps.put(pattern + (n,) * each, some)
            wanted -= some * each
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for groups in gaps.groups.values():
        for pattern, times in groups:
            merged[tuple(sorted(pattern, reverse=True))] += times
    return sorted(merged.items())


def grouped(left: dict[int, int]) -> list[list[int]]:
    """The lengths in at most CLASSES runs of neighbours with about the same number of tokens each; one by one where there are no more."""
    lengths = sorted(left)
    if len(lengths) <= CLASSES:
        return [[n] for n in lengths]
    mass = np.cumsum([n * left[n] for n in lengths])
    where = ((mass - 1) * CLASSES // mass[-1]).astype(int)
    return [[n for n, w in zip(lengths, where, strict=True) if w == k] for k in np.unique(where)]


def by_configurations(histogram: dict[int, int], capacity: int) -> Planned:
    """The plan by the configuration linear program, with best fit for what is left of rounding."""
    unit = 1 if len(histogram) <= CLASSES else max(1, capacity // RESOLUTION)
    up = lambda own: -(-own[-1] // unit)
    left, held = dict(histogram), {}
    total = sum(n * c for n, c in histogram.items())
    for _ in range(2):  # held back: the shortest pieces, SPARE of the tokens and as many as classes are longer than their members
        spare = (int(SPARE * total) if len(histogram) > CLASSES else 0) + sum(left[n] * (unit * up(own) - n) for own in grouped(left) for n in own)
        left, held = dict(histogram), {}
        for n in sorted(histogram):
            if spare < n:
                break
            held[n] = some = min(histogram[n], spare // n)
            spare -= some * n
            left[n] -= some
            if not left[n]:
                del left[n]
        if not left:
            break
    classes, gaps = grouped(left) if left else [], Gaps(capacity)
    merged: dict[int, list[int]] = defaultdict(list)
    for own in classes:
        merged[up(own)] += own
    sizes, classes = np.array(sorted(merged)), [merged[k] for k in sorted(merged)]
    demand = np.array([sum(left[n] for n in own) for own in classes], float)
    for config, times in sorted(solve_configurations(sizes, demand, capacity // unit), key=lambda x: -x[1]):
        has = np.flatnonzero(config)
        open_ = {(): min(int(np.ceil(times)), *(sum(left[n] for n in classes[k]) // int(config[k]) for k in has))}  # rounded up, as far as there are pieces
        for k in np.repeat(np.arange(len(sizes)), config)[::-1].tolist():
            filled: dict[tuple[int, ...], int] = defaultdict(int)
            for pattern, wanted in open_.items():
                while wanted and classes[k]:
                    n = classes[k][-1]
                    some = min(wanted, left[n])
                    filled[(*pattern, n)] += some
                    wanted -= some
                    left[n] -= some
                    if not left[n]:
                        classes[k].pop()
                if wanted:
                    filled[pattern] += wanted
            open_ = filled
        for pattern, some in open_.items():
            if some and pattern:
                gaps.put(pattern, some)
    for n, c in held.items():
        left[n] = left.get(n, 0) + c
    return best_fit({n: c for n, c in left.items() if c}, gaps)


def sequences(planned: Planned) -> int:
    return sum(times for _, times in planned)


def plan(histogram: dict[int, int], capacity: int) -> Planned:
    """[(lengths in a sequence, sequences that have them)], for all of histogram {length: pieces}."""
    wanted = {n: c for n, c in histogram.items() if c}
    return min(by_configurations(wanted, capacity), best_fit(wanted, Gaps(capacity)), key=sequences)


def slots(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank of each run of ranks, its sequences, its first sequence, offset of its first copy."""
    found: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    base = 0
    for pattern, times in planned:
        at = 0
        for n in dict.fromkeys(pattern):
            found[n].append((ranks[n], times, base, at))
            copies = pattern.count(n)
            ranks[n] += copies * times
            at += n * copies
        base += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for n, rows in found.items()}


def place(lengths: np.ndarray, ranks: np.ndarray, where: dict[int, tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the rank-th piece of its length."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        n = int(lengths[rows[0]])
        first, times, base, at = where[n]
        run = np.searchsorted(first, ranks[rows], "right") - 1
        copy, sequence_in = np.divmod(ranks[rows] - first[run], times[run])
        sequence[rows] = base[run] + sequence_in
        offset[rows] = at[run] + copy * n
    return sequence, offset


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of docs(doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.keep(pieces(docs, tokenizer, capacity, end_id))
    histogram = {int(n): int(c) for n, c in cut.groupBy("length").count().collect()}
    where = slots(plan(histogram, capacity))
    part = max(LEAST_PART, sum(histogram.values()) // PARTS)
    many = {n: -(-c // part) for n, c in histogram.items()}
    parts = F.create_map([F.lit(x) for kv in many.items() for x in kv])[F.col("length")] if many else F.lit(1)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id()), parts.cast("long")))
    salted = scratch.keep(salted)  # the salt is dealt once
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")).cast("long") - 1)
    counts = {(int(r[0]), int(r[1])): int(r[2]) for r in salted.groupBy("length", "salt").count().collect()}
    before: dict[tuple[int, int], int] = {}
    for n, k in many.items():
        total = 0
        for s in range(k):
            before[n, s] = total
            total += counts.get((n, s), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, salt, ranks = (batch.column(i).to_numpy() for i in (3, 5, 6))
            ranks = ranks + np.array([before.get(key, 0) for key in zip(lengths.tolist(), salt.tolist(), strict=True)], np.int64)
            sequence, offset = place(lengths, ranks, where)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(frugal(run), PIECES + ", sequence_id long, offset long")

"""Word-level edits: counts, corpus and sample error rates, edit pairs.

The alignment is a least-cost one; where several are, a deletion is taken before an insertion and that before a match or substitution, from
the end. It is a dynamic program, so it runs in Arrow functions, for many pairs at once: pairs of a batch are padded to blocks of at most
CELLS cells, and a step of numpy works on a row of all of them. Counts alone need two rows; the paths of edit pairs keep two bits a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.numbers import exact_round

#: Cells of a block of pairs; a larger pair stands alone.
CELLS = 1 << 24
#: Bytes of text that are aligned at once, with ROW more for each row; a longer row stands alone. As words and numbers they take about twenty times as much.
SLICE, ROW = 1 << 20, 64
#: The names of edits, the least similarity of similar words, the notes on them, and the rate that is marked as high.
KINDS = ("substitution", "deletion", "insertion")
SIMILAR, NOTES = 0.6, ("similar form (heuristic)", "different word (heuristic)")
HIGH_WER, HIGH_MARK = 0.5, " [HIGH_WER]"
COUNTS = ("hits", "substitutions", "deletions", "insertions")


def coded(pairs: list[tuple[list[str], list[str]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Words as numbers, the same for equal words."""
    index: dict[str, int] = {}
    return [tuple(np.array([index.setdefault(w, len(index)) for w in side], np.int64) for side in pair) for pair in pairs]


def blocks(sizes: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Pairs of about the same lengths, with at most CELLS cells in a block."""
    order = sorted(range(len(sizes)), key=lambda i: sizes[i])
    block: list[int] = []
    rows = columns = 0
    for i in order:
        n, m = max(rows, sizes[i][0]), max(columns, sizes[i][1])
        if block and (n + 1) * (m + 1) * (len(block) + 1) > CELLS:
            yield block
            block, n, m = [], *sizes[i]
        block.append(i)
        rows, columns = n, m
    if block:
        yield block


def filled(refs: list[np.ndarray], hyps: list[np.ndarray], paths: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(distance, deletions) of each pair, and with paths for each row the packed bits of cells whose path ends in a deletion, and in an insertion."""
    n, m, many = max(map(len, refs)), max(map(len, hyps)), len(refs)
    ref, hyp = np.full((many, n), -1, np.int64), np.full((many, m), -2, np.int64)
    for k, (r, h) in enumerate(zip(refs, hyps, strict=True)):
        ref[k, : len(r)], hyp[k, : len(h)] = r, h
    lengths, ends = np.array([len(r) for r in refs]), np.array([len(h) for h in hyps])
    steps = np.arange(m + 1, dtype=np.int32)
    cost = np.broadcast_to(steps, (many, m + 1)).copy()
    gone = np.zeros((many, m + 1), np.int32)
    lanes = np.arange(many)
    distance, deleted = np.where(lengths == 0, ends, 0).astype(np.int32), np.zeros(many, np.int32)
    down: list[np.ndarray] = []
    across: list[np.ndarray] = []
    for i in range(1, n + 1):
        above, before = cost + 1, cost
        row = above.copy()
        np.minimum(row[:, 1:], before[:, :-1] + (hyp != ref[:, i - 1 : i]), out=row[:, 1:])
        row = np.minimum.accumulate(row - steps, axis=1) + steps  # a run of insertions costs its length
        is_down = row == above
        is_across = np.zeros_like(is_down)
        is_across[:, 1:] = ~is_down[:, 1:] & (row[:, 1:] == row[:, :-1] + 1)
        if paths:
            down.append(np.packbits(is_down, axis=1))
            across.append(np.packbits(is_across, axis=1))
        own = np.where(is_down, gone + 1, 0)
        own[:, 1:] = np.where(is_down[:, 1:], own[:, 1:], gone[:, :-1])
        source = np.maximum.accumulate(np.where(is_across, 0, steps), axis=1)  # insertions keep the count of the cell they start from
        cost, gone = row, np.take_along_axis(own, source, 1)
        done = lengths == i
        distance[done], deleted[done] = cost[lanes[done], ends[done]], gone[lanes[done], ends[done]]
    return distance, deleted, down, across


def edit_counts(pairs: list[tuple[list[str], list[str]]]) -> np.ndarray:
    """A row (hits, substitutions, deletions, insertions) for each pair."""
    out = np.zeros((len(pairs), 4), np.int64)
    numbers = coded(pairs)
    for block in blocks([(len(r), len(h)) for r, h in numbers]):
        refs, hyps = [numbers[i][0] for i in block], [numbers[i][1] for i in block]
        distance, deleted, _, _ = filled(refs, hyps, paths=False)
        n, m = np.array([len(r) for r in refs]), np.array([len(h) for h in hyps])
        inserted = deleted + m - n
        replaced = distance - deleted - inserted
        out[block] = np.stack([n - deleted - replaced, replaced, deleted, inserted], 1)
    return out


def edit_paths(pairs: list[tuple[list[str], list[str]]]) -> list[list[tuple[str, str, str]]]:
    """(kind, reference word, hypothesis word) of the edits of each pair, in order."""
    out: list[list[tuple[str, str, str]]] = [[] for _ in pairs]
    numbers = coded(pairs)
    for block in blocks([(len(r), len(h)) for r, h in numbers]):
        _, _, down, across = filled([numbers[i][0] for i in block], [numbers[i][1] for i in block], paths=True)
        for lane, k in enumerate(block):
            (ref, hyp), (r, h) = pairs[k], numbers[k]
            i, j, found = len(ref), len(hyp), out[k]
            while i and j:
                byte, bit = j >> 3, 7 - (j & 7)
                if down[i - 1][lane, byte] >> bit & 1:
                    i -= 1
                    found.append((KINDS[1], ref[i], ""))
                elif across[i - 1][lane, byte] >> bit & 1:
                    j -= 1
                    found.append((KINDS[2], "", hyp[j]))
                else:
                    i, j = i - 1, j - 1
                    if r[i] != h[j]:
                        found.append((KINDS[0], ref[i], hyp[j]))
            found += [(KINDS[1], w, "") for w in reversed(ref[:i])] + [(KINDS[2], "", w) for w in reversed(hyp[:j])]
            found.reverse()
    return out


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most SLICE bytes in its first two columns, so that a worker's memory doesn't grow with the rows of a batch."""
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:2]) + ROW)
    start = 0
    while start < batch.num_rows:
        gone = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, gone + SLICE, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def split_pairs(batch: pa.RecordBatch) -> list[tuple[list[str], list[str]]]:
    return [((a or "").split(), (b or "").split()) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]


def counted(rows: DataFrame, reference: Column, hypothesis: Column, keep: list[str]) -> DataFrame:
    """The columns keep and (hits, substitutions, deletions, insertions) of the words of each row; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(slices, batches)):
            counts = edit_counts(split_pairs(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *(pa.array(c) for c in counts.T)], [*keep, *COUNTS])

    schema = rows.select(*keep).schema
    for name in COUNTS:
        schema = schema.add(name, "long")
    return rows.select(reference.alias("_reference"), hypothesis.alias("_hypothesis"), *keep).mapInArrow(run, schema)


def word_error_rate(hits="hits", substitutions="substitutions", deletions="deletions", insertions="insertions") -> Column:
    """Null where there are no reference words."""
    s, d, i, h = map(F.col, (substitutions, deletions, insertions, hits))
    return F.try_divide(s + d + i, h + s + d)


def scored(rows: DataFrame, reference: str, hypothesis: str, keep: list[str]) -> DataFrame:
    """Sample scores: keep, wer, cer, substitutions, deletions, insertions, reference_words, and what corpus rates add up (hits, char_edits, chars).

    Both texts lose punctuation first and nothing else. No rate where the reference has no words.
    """
    begins, longer = F.startswith("_r", "_h") | F.startswith("_h", "_r"), F.char_length("_r") - F.char_length("_h")
    chars = F.when(begins, F.abs(longer)).otherwise(F.levenshtein("_r", "_h")).cast("long")  # of a text and its own beginning: the difference in length
    plain = rows.withColumns({"_r": text.strip_punctuation(F.coalesce(reference, F.lit(""))), "_h": text.strip_punctuation(F.coalesce(hypothesis, F.lit("")))})
    plain = plain.withColumns({"char_edits": chars, "chars": F.char_length("_r").cast("long")})
    out = counted(plain, F.col("_r"), F.col("_h"), [*keep, "char_edits", "chars"])
    return out.withColumns({"reference_words": F.expr("hits + substitutions + deletions"), "wer": word_error_rate(), "cer": F.try_divide("char_edits", "chars")})


def corpus_rates(found: DataFrame, *by: str, more: dict[str, Column] | None = None) -> DataFrame:
    """Micro-averaged rates of scored rows, for all or by group; of no rows: 0 words, null rates and counts. more: further aggregates by name, taken in the same pass."""
    names = ("substitutions", "deletions", "insertions", "reference_words", "char_edits", "chars")
    out = found.groupBy(*by).agg(F.count(F.lit(1)).alias("evaluated_samples"), *[F.sum(c).alias(c) for c in names], *[v.alias(k) for k, v in (more or {}).items()])
    rates = {"wer": F.try_divide(F.expr("substitutions + deletions + insertions"), F.col("reference_words")), "cer": F.try_divide("char_edits", "chars")}
    return out.withColumns(rates | {"reference_words": F.coalesce("reference_words", F.lit(0))}).drop("char_edits", "chars")


def edits_in_order(rows: DataFrame, reference: Column, hypothesis: Column, seq: Column) -> DataFrame:
    """(type, reference_word, hypothesis_word, seq, place) of each edit; seq: the row's place in the input, place: the edit's in its row."""
    kind = "type string, reference_word string, hypothesis_word string, seq long, place long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(slices, batches)):
            found = edit_paths(split_pairs(batch))
            flat = [e for one in found for e in one]
            columns = [pa.array([e[k] for e in flat], pa.string()) for k in range(3)]
            own = np.repeat(batch.column(2).to_numpy(zero_copy_only=False), [len(one) for one in found])
            place = np.concatenate([np.arange(len(one)) for one in found])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.int64()), pa.array(place, pa.int64())], ["type", "reference_word", "hypothesis_word", "seq", "place"])

    return rows.select(reference.alias("r"), hypothesis.alias("h"), seq.cast("long").alias("seq")).mapInArrow(run, kind)


def similarity(a: Column, b: Column) -> Column:
    """Matching characters of the longest common runs, twice, over both lengths; for few distinct pairs, as it runs in Python."""

    @F.pandas_udf("double")
    def ratio(left, right):
        return left.combine(right, lambda x, y: SequenceMatcher(None, x, y).ratio()).astype("float64")

    return ratio(a, b)


def edit_pairs(edits: DataFrame) -> DataFrame:
    """(type, reference_word, hypothesis_word, count, similarity, heuristic_note, first_seq, first_place) of distinct edits.

    Order by count descending, first_seq, first_place for the most frequent first, ties in the order they were seen in.
    """
    same = ["type", "reference_word", "hypothesis_word"]
    first = F.min(F.struct("seq", "place"))
    found = edits.groupBy(*same).agg(F.count(F.lit(1)).alias("count"), first.alias("first"))
    alike = F.when(F.col("type") == KINDS[0], similarity(F.col("reference_word"), F.col("hypothesis_word")))
    noted = found.withColumn("similarity", alike)
    note = F.when(F.col("similarity") >= SIMILAR, NOTES[0]).when(F.col("similarity").isNotNull(), NOTES[1]).otherwise("")
    return noted.select(*same, "count", exact_round(F.col("similarity"), 2).alias("similarity"), note.alias("heuristic_note"), F.col("first.seq").alias("first_seq"), F.col("first.place").alias("first_place"))


def substitution_totals(pairs: DataFrame) -> DataFrame:
    """(similar, all): substitutions with similar words, and all, weighted by their counts."""
    n = F.when(F.col("type") == KINDS[0], F.col("count")).otherwise(0)
    alike = F.when(F.col("heuristic_note") == NOTES[0], n).otherwise(0)
    return pairs.agg(F.coalesce(F.sum(alike), F.lit(0)).alias("similar"), F.coalesce(F.sum(n), F.lit(0)).alias("all"))


def top_substitutions(pairs: DataFrame, most: int = 25) -> DataFrame:
    return pairs.filter(F.col("type") == KINDS[0]).orderBy(F.desc("count"), "first_seq", "first_place").limit(most)


def error_summaries(samples: DataFrame, reference: str, prediction: str, keep: list[str]) -> DataFrame:
    """keep, wer and error_summary of each sample, over the raw words; a mark where its wer column is HIGH_WER or more."""
    counts = counted(samples, F.col(reference), F.col(prediction), [*keep, "wer"])
    told = F.format_string("substitutions=%d deletions=%d insertions=%d hits=%d", "substitutions", "deletions", "insertions", "hits")
    return counts.select(*keep, "wer", F.concat(told, F.when(F.col("wer") >= HIGH_WER, HIGH_MARK).otherwise("")).alias("error_summary"))

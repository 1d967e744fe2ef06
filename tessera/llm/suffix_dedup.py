"""Removal of every byte under a string of `width` bytes that also starts elsewhere in the corpus.

1. Each text of at least width bytes has a 128-bit key; a key with several rows is a text with copies, and goes whole.
2. Windows of width bytes are dealt to anchors: the least of the hashes of a window's GRAM-byte grams, leftmost on ties. Equal windows
   have the same anchor at the same offset, so only windows of an anchor that stands in two places can be repeated. A run of
   windows with one anchor is one row: anchor, place, offsets, and a hash of all the run's bytes. Equal runs are settled; one of
   them goes on where its anchor has other runs, which may match a part of it. The same holds for equal blocks below.
3. The other runs of repeated anchors are cut by offset into blocks of BLOCK windows. Equal blocks are settled as repeated, blocks
   whose core (the bytes that all of its windows share) stands once are settled as not repeated.
4. What is left are blocks in which a match begins or ends. Where HOT or more have one core (a passage in very many texts), hashes of their
   windows are counted, as windows of one anchor can only be equal at the same offset. The other blocks' bytes, grouped by core, go to external induced sorting with
   common-prefix lengths (induced.py), which says of each window whether it occurs twice.
5. The spans of all windows found are united for each key, and each row with the key loses them.

Counts come from partial aggregates (the least and the greatest place with a hash; two places differ if these do), so a passage in
a third of all texts is one row for each task. Equality in steps 1 to 3 is by 128 bits of hash in all, in step 4 by bytes.

Null text is empty text. Null ids and repeated rows are kept; repeated rows of at least width bytes remove each other. An
empty table gives no rows; other columns pass through `kept_texts` untouched and are not read by `removals`.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import Scratch, byte_slices, frugal, frugal_group, recounted
from .induced import repeated_windows

#: Bytes of a gram, windows of a block, bytes of text that are hashed at once (of a long text too; about 15 words of 8 bytes each are held), bytes of a shard for sorting, about.
GRAM, BLOCK, SLICE, SHARD = 128, 32, 256 << 10, 1 << 20
#: Blocks with one core from which on they are compared window by window, with partial aggregates, instead of sorted in one shard.
HOT = 2_000
#: An odd base of the rolling hash and the multipliers of its finish.
BASE = 0x9E3779B97F4A7C15
FINISH = (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
#: Bits of a place in what is hashed at once: up to two slices, with what windows reach beyond a part.
PLACE = 20
RUNS = "h long, k1 long, k2 long, p long, t0 int, t1 int, f long"


def key_of(raw: bytes) -> tuple[int, int]:
    digest = hashlib.md5(raw, usedforsecurity=False).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


class Rolling:
    """Hashes of any stretches of a byte string of up to 2**PLACE bytes, from prefix sums."""

    def __init__(self, raw: bytes):
        text = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(text * self.powers(BASE)[: len(text)], out=self.sums[1:])
        self.back = self.powers(pow(BASE, -1, 1 << 64))

    @staticmethod
    @functools.cache
    def powers(base: int) -> np.ndarray:
        """Made once in a worker."""
        out = np.full((1 << PLACE) + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[first]) * self.back[first]
        for multiplier in FINISH:
            x = (x ^ (x >> np.uint64(31))) * np.uint64(multiplier)
        return x ^ (x >> np.uint64(32))


def runs(raws: list[bytes], width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, place of the anchor, first window, last window, anchor's hash, hash of the run's bytes) of each run, in order."""
    sizes = np.array([len(r) for r in raws])
    ends = np.cumsum(sizes)
    raw = b"".join(raws)
    windows = len(raw) - width + 1
    rolling, at = Rolling(raw), np.arange(len(raw) - gram + 1)
    hashes = rolling.of(at, at + gram)
    low = np.uint64((1 << PLACE) - 1)
    keyed = (hashes & ~low) | at.astype(np.uint64)
    span = width - gram + 1
    rows = np.concatenate([keyed, np.full(-len(keyed) % span, 2**64 - 1, np.uint64)]).reshape(-1, span)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(right[:windows], left[span - 1 : span - 1 + windows]) & low).astype(np.int64)
    text = np.repeat(np.arange(len(raws)), sizes)[:windows]
    start = np.flatnonzero(np.arange(windows) + width <= ends[text])
    anchor, text = anchor[start], text[start]
    cut = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    first, last = start[cut], start[np.append(cut[1:], len(start)) - 1]
    place, text = anchor[cut], text[cut]
    begins = (ends - sizes)[text]
    return text, place - begins, first - begins, last - begins, hashes[place].view(np.int64), rolling.of(first, last + width).view(np.int64)


def long_slices(texts: pa.Array, width: int, limit: int) -> Iterator[tuple[list[bytes], list[int]]]:
    """Texts of at least width bytes in slices of about limit bytes, and their rows."""
    sizes = pc.binary_length(texts).to_numpy()
    rows = np.flatnonzero(sizes >= width)
    for a, b in byte_slices(sizes[rows], limit):
        yield [texts[int(i)].as_py() for i in rows[a:b]], rows[a:b].tolist()


def parts_of(raw: bytes, width: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of parts that hold each window of width bytes once, small enough for places in PLACE bits."""
    for at in range(0, max(1, len(raw) - width + 1), SLICE):
        yield at, raw[at : at + SLICE + width - 1]


def all_runs(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """Runs of each text; key, and offsets t0..t1 of the anchor in the run's windows, last window first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(0).cast(pa.large_binary()), b"")
            for raws, _ in long_slices(texts, width, SLICE):
                keys = np.array([key_of(r) for r in raws], np.int64)
                parts = [(k, at, part) for k, r in enumerate(raws) for at, part in parts_of(r, width)]
                for a, b in byte_slices([len(p[2]) for p in parts], SLICE + width):
                    text, p, first, last, h, f = runs([x[2] for x in parts[a:b]], width, gram)
                    own = np.array([x[0] for x in parts[a:b]])[text]
                    move = np.array([x[1] for x in parts[a:b]])[text]
                    columns = [h, keys[own, 0], keys[own, 1], p + move, (p - last).astype(np.int32), (p - first).astype(np.int32), f]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "k1", "k2", "p", "t0", "t1", "f"])

    return docs.select("text").mapInArrow(frugal(run), RUNS)


def twice(rows: DataFrame, *by: str) -> DataFrame:
    """(by, whether two places have it, the least place) of rows with a place k1, k2, p."""
    place = F.struct("k1", "k2", "p")
    return rows.groupBy(*by).agg(F.min(place).alias("lo"), F.max(place).alias("hi")).select(*by, (F.col("lo") != F.col("hi")).alias("twice"), "lo")


def unsettled(rows: DataFrame, settled: DataFrame, by: list[str], group: list[str], scratch: Scratch) -> DataFrame:
    """rows that are not whole, and of the equal rows that are, the one in the least place where its group has others: their match may lie in it."""
    joined = rows.join(settled, by).filter((~F.col("whole")) | (F.struct("k1", "k2", "p") == F.col("lo"))).drop("lo")
    others = scratch.keep(settled.filter("not whole").select(*group).distinct())
    return joined.join(others, group, "left_semi")


def keyed_texts(docs: DataFrame, width: int, others: bool) -> DataFrame:
    """docs with text as key columns k1, k2 and raw bytes; texts under width bytes have no key, and are left out unless others."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    digest = F.when(F.octet_length("raw") >= width, F.md5("raw"))

    def half(at: int) -> F.Column:  # as key_of: 8 bytes, little-endian, signed
        swapped = F.concat(*[F.substring(digest, at + 2 * i + 1, 2) for i in range(7, -1, -1)])
        high, low = F.conv(F.substring(swapped, 1, 8), 16, 10).cast("long"), F.conv(F.substring(swapped, 9, 8), 16, 10).cast("long")
        return F.shiftleft(high, 32).bitwiseOR(low)

    out = docs.withColumn("raw", raw).withColumns({"k1": half(0), "k2": half(16)})
    return out if others else out.filter("k1 is not null")


def blocks(texts: DataFrame, open_runs: DataFrame, width: int) -> DataFrame:
    """The blocks of open runs: (h, b, k1, k2, p, t0, t1, core, f, bytes)."""
    listed = open_runs.groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "p", "t0", "t1")).alias("runs"))
    one = texts.select("k1", "k2", "raw").join(listed, ["k1", "k2"])
    schema = "h long, b int, k1 long, k2 long, p long, t0 int, t1 int, core long, f long, bytes binary"

    def cut(held: list[tuple]) -> pa.RecordBatch:
        """Blocks of runs (k1, k2, h, p, t0, t1, bytes); their bytes stand one after the other."""
        joined = b"".join(x[6] for x in held)
        rolling, out, begin = Rolling(joined), [], 0
        for k1, k2, h, p, t0, t1, raw in held:
            move = begin - (p - t1)  # from a place in the text to one in joined
            for b in range(t0 // BLOCK, t1 // BLOCK + 1):
                low, high = max(t0, BLOCK * b), min(t1, BLOCK * b + BLOCK - 1)
                core = p - BLOCK * b + move
                out.append((h, b, k1, k2, p, low, high, core, core - BLOCK + 1 + width, p - high + move, p - low + width + move))
            begin += len(raw)
        c = [np.array(x, np.int64) for x in zip(*out, strict=True)]
        core, whole = rolling.of(c[7], c[8]).view(np.int64), rolling.of(c[9], c[10]).view(np.int64)
        columns = [pa.array(c[0]), pa.array(c[1], pa.int32()), *(pa.array(x) for x in c[2:5]), pa.array(c[5], pa.int32()), pa.array(c[6], pa.int32()), pa.array(core), pa.array(whole), pa.array([joined[x[9] : x[10]] for x in out], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["h", "b", "k1", "k2", "p", "t0", "t1", "core", "f", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                k1, k2, raw = (batch.column(i)[row].as_py() for i in range(3))
                own = batch.column(3)[row].values.flatten()
                for h, p, t0, t1 in zip(*(x.to_numpy().tolist() for x in own), strict=True):
                    held.append((k1, k2, h, p, t0, t1, raw[p - t1 : p - t0 + width]))
                    size += len(held[-1][6])
                    if size >= SLICE:
                        yield cut(held)
                        held, size = [], 0
        if held:
            yield cut(held)

    return one.mapInArrow(frugal(run), schema)


def single_windows(left: DataFrame, width: int) -> DataFrame:
    """Each window of blocks: (h, k1, k2, p, t, f), f a hash of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [x.as_py() for x in batch.column(5)]
            n = np.array([len(r) - width + 1 for r in raws], np.int64)
            row = np.repeat(np.arange(len(raws)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            f = [r.of(np.arange(k), np.arange(k) + width).view(np.int64) for r, k in zip(map(Rolling, raws), n, strict=True)]
            h, k1, k2, p, t1 = (batch.column(i).to_numpy()[row] for i in range(5))
            columns = [h, k1, k2, p, (t1 - at).astype(np.int32), np.concatenate(f) if f else np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "k1", "k2", "p", "t", "f"])

    return left.select("h", "k1", "k2", "p", "t1", "bytes").mapInArrow(frugal(run), "h long, k1 long, k2 long, p long, t int, f long")


def spans(docs: DataFrame, width: int, scratch: Scratch, gram: int) -> tuple[DataFrame, DataFrame]:
    """(k1, k2) of texts with copies, and (k1, k2, spans) of the others that lose bytes."""
    every = scratch.keep(all_runs(docs, width, gram))
    rows = keyed_texts(docs, width, others=False)
    copied = scratch.keep(rows.groupBy("k1", "k2").count().filter("count > 1").select("k1", "k2", F.lit(True).alias("copied")))
    # Small sides of joins by anchor are written out first: an aggregate right below a join keeps AQE from splitting a hot anchor.
    anchors = scratch.keep(twice(every, "h").filter("twice").select("h"))
    near = every.join(anchors, "h")
    near = scratch.keep(near)
    scratch.drop(every)
    same = ["h", "t0", "t1", "f"]
    settled = scratch.keep(twice(near, *same).withColumnRenamed("twice", "whole"))
    cover = F.struct((F.col("p") - F.col("t1")).alias("a"), (F.col("p") - F.col("t0") + width).alias("b"))
    # Spans are written by themselves: below a union AQE would not split the join of a run or block that stands in very many places.
    first = scratch.keep(near.join(settled.filter("whole").select(*same), same).select("k1", "k2", cover.alias("s")).distinct())
    open_runs = unsettled(near, settled, same, ["h"], scratch).select("h", "k1", "k2", "p", "t0", "t1")  # blocks() takes each once

    # A text with copies goes whole, and one copy of its bytes is enough to find others.
    cut = scratch.keep(blocks(rows.dropDuplicates(["k1", "k2"]), open_runs, width))
    scratch.clear(copied, first, cut)
    places = cut.drop("bytes")
    same, group = ["h", "b", "t0", "t1", "f", "core"], ["h", "b", "core"]
    whole = scratch.keep(twice(places, *same).withColumnRenamed("twice", "whole"))
    core = scratch.keep(twice(places, *group).filter("twice").select(*group))
    second = scratch.keep(places.join(whole.filter("whole").select(*same), same).select("k1", "k2", cover.alias("s")).distinct())
    left = unsettled(cut, whole, same, group, scratch).join(core, group, "left_semi")
    left = scratch.keep(left.select("h", "b", "core", "k1", "k2", "p", "t1", "bytes"))
    scratch.clear(copied, first, second, left)
    hot = scratch.keep(left.groupBy(*group).count().filter(F.col("count") >= HOT).select(*group))
    windows = scratch.keep(single_windows(left.join(hot, group, "left_semi"), width))
    fourth = windows.join(twice(windows, "h", "t", "f").filter("twice").select("h", "t", "f"), ["h", "t", "f"]).select("k1", "k2", F.struct((F.col("p") - F.col("t")).alias("a"), (F.col("p") - F.col("t") + width).alias("b")).alias("s"))
    left = scratch.keep(left.join(hot, group, "left_anti"))
    size = left.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(1, -(-size // SHARD))

    def work(group: pa.Table) -> pa.Table:
        found = repeated_windows(group.column("bytes").to_pylist(), width)
        n = np.array([len(x) for x in found])
        hit = np.flatnonzero(np.concatenate(found)) if len(found) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(found)), n)[hit]
        at = hit - (np.cumsum(n) - n)[row]
        cuts = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(at, prepend=-9) != 1))
        ends = np.append(cuts[1:], len(row)) - 1 if len(row) else cuts
        begin = group.column("p").to_numpy()[row] - group.column("t1").to_numpy()[row] if len(row) else np.zeros(0, np.int64)
        return pa.table({"k1": group.column("k1").to_numpy()[row[cuts]], "k2": group.column("k2").to_numpy()[row[cuts]], "a": begin[cuts] + at[cuts], "b": begin[ends] + at[ends] + width})

    third = left.withColumn("shard", F.pmod(F.xxhash64("h", "b", "core"), F.lit(shards))).groupBy("shard").applyInArrow(frugal_group(work), "k1 long, k2 long, a long, b long")
    third = third.select("k1", "k2", F.struct("a", "b").alias("s"))
    third, fourth = (scratch.keep(x.distinct()) for x in (third, fourth))
    lost = first.unionByName(second).unionByName(third).unionByName(fourth).distinct().groupBy("k1", "k2").agg(F.collect_list("s").alias("spans"))
    lost = scratch.keep(lost)
    scratch.clear(copied, lost)
    return copied, lost


def united(found: list[dict] | None, copied: bool | None, size: int) -> list[tuple[int, int]]:
    """Maximal removed runs."""
    if copied:
        return [(0, size)]
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in found or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def joined(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """docs with the columns raw, spans and copied."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    copied, lost = spans(docs.select("text"), width, scratch, gram)
    lost = lost.join(copied, ["k1", "k2"], "full_outer")
    return keyed_texts(docs, width, others=True).join(lost, ["k1", "k2"], "left")


def removals(docs: DataFrame, width: int = 400, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, found, copied in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                raw = raw.as_py()
                gone = united(found.as_py(), copied.as_py(), len(raw))
                kept = b"".join(raw[a:b] for a, b in zip([0, *(g[1] for g in gone)], [*(g[0] for g in gone), len(raw)], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
            n, removed, count, digest = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = joined(docs.select("doc_id", "text"), width, gram).select("doc_id", "raw", "spans", "copied")
    return found.mapInArrow(frugal(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_texts(docs: DataFrame, width: int = 400, gram: int = GRAM) -> DataFrame:
    """docs with what is left of each text; a character that loses a byte goes whole. Null text becomes empty text; n_chars, if there, is counted anew."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, found, copied in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                raw = raw.as_py()
                gone = united(found.as_py(), copied.as_py(), len(raw))
                parts = zip([0, *(g[1] for g in gone)], [*(g[0] for g in gone), len(raw)], strict=True)
                out.append("".join(raw[a:b].decode("utf-8", "ignore") for a, b in parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "text"])

    packed = docs.select("text", F.struct(*others).alias("row"))
    found = joined(packed, width, gram).select("row", "raw", "spans", "copied")
    kind = StructType([StructField("row", StructType([docs.schema[c] for c in others])), StructField("text", StringType())])
    flat = found.mapInArrow(frugal(run), kind)
    return recounted(flat.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]))

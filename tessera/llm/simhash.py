"""Near-duplicate documents by SimHash fingerprints and a vantage-point partition of Hamming space.

Fingerprints. Words of the text in ASCII lower case, shingles of `words` words, XXH64 of each; a bit is set if it is set in over
half of the hashes. Counting goes by bytes of eight-bit counters packed in 64-bit words, at most 255 hashes a counter.

Links. Only distinct fingerprints are compared, so that any number of exact copies is one point. A tree of vantage points built on
a bounded sample deals the points into shards: at each node a point at distance d from the vantage point goes inside if d <= cut and
outside if d > cut. By the triangle inequality two points within `radius` that fall on different sides have d in
(cut - radius, cut] and (cut, cut + radius]; so it suffices that inside points with d > cut - radius also visit the
outside. No pair is lost, and the overlap is two of the 65 distances, not a shell on both sides. Each shard is
then joined by the same recursion down to small blocks that are compared outright. A shard reports a spanning forest of
its links, never its pairs: one edge a point at most.

The stage form (representatives) links by the exact Jaccard similarity of whole shingle sets. Its candidates are found by fingerprints too, of WIDE * 64 bits
of each set, within REACH bits. A bit of two sets of similarity 0.8 differs with a chance of at most 0.1875 (4 of 5 shingles; 0.161 from 12 on), so that
such a pair is missed with a chance of 1e-5 (3e-8); sets without a common shingle are within it with one of 5e-11. The same tree deals them into shards. Independent texts are
all about equally far apart, and no partition of Hamming space parts them at such a radius, so a shard that stays large is cut by the sets' sizes,
which similar sets share up to a factor, and into lots: every pair of lots that may hold links is a task, compared outright. Each task reports a
spanning forest. Members of a group of close fingerprints first meet its pivots, a row a member. Groups that still hold several components
are then dealt out with their sets, a task a group; a group beyond LOT shingles is cut into lots, a task each pair of lots. A task joins its sets exactly by their
rarest shingles, so that no candidate pair between components goes unverified, and texts with a common passage aren't all paired; it reports a forest, never its pairs.

Null text is empty text: fingerprint zero, linked like any other. Null ids are kept, and take their group's smallest known id
(null if there is none). Repeated rows are all returned. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, byte_slices, components, fresh, frugal, frugal_group

#: Points in the sample that the top of the tree is built on, points in a shard (more only where the tree is full), most shards, and points of a block.
SAMPLE, SHARD, SHARDS, BLOCK = 16_384, 4_000, 4096, 96
SLICE = 1 << 20
#: Stage form: 64-bit words of a fingerprint, differing bits of candidates, in all and in the first two words (1.4e-6 of pairs at 0.8 at worst have more there),
#: lots that a corpus beyond LOTS * SHARD points is cut in, rows and columns of a tile, turns of pivots.
WIDE, REACH, HALF, LOTS, TILE, WIDTH, PIVOTS = 4, 76, 46, 64, 16, 4_096, 2
#: Shingles of a lot of a group of sets, about, and of candidates that are verified at once.
LOT, CHECKED = 1 << 19, 1 << 16
LANES = np.uint64(0x0101010101010101)
#: What names a task of the stage form: the shard, and level of sizes and lot of both of its sides.
MEETING = ["shard", "i", "x", "j", "y"]


def hashes(raw: bytes, words: int) -> list[int]:
    """XXH64 of each shingle of a text (UTF-8)."""
    import xxhash

    found = raw.lower().split()
    if not found:
        return []
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(found), 42)]
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    starts = [0]
    for w in found:
        starts.append(starts[-1] + len(w) + 1)
    return [digest(joined[a : b - 1], 42) for a, b in zip(starts, starts[words:], strict=False)]


def majority(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of sizes hashes: the bits set in over half of them."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    ends = np.cumsum(sizes)
    parts = -(-sizes[full] // 255)
    first = np.concatenate([[0], np.cumsum(parts)[:-1]])
    within = np.arange(parts.sum()) - np.repeat(first, parts)
    chunk = np.repeat(ends[full] - sizes[full], parts) + 255 * within
    for k in range(8):
        lanes = np.add.reduceat((values >> np.uint64(k)) & LANES, chunk).view(np.uint8).reshape(-1, 8)
        set_ = np.add.reduceat(lanes.astype(np.int64), first, axis=0) * 2 > sizes[full][:, None]
        for lane in range(8):
            out[full] |= set_[:, lane].astype(np.uint64) << np.uint64(8 * lane + k)
    return out


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp) of docs(doc_id, text), and row if docs has it third; fp is the fingerprint as a signed long."""
    more = docs.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
            found = []
            for a, b in byte_slices(pc.binary_length(texts).to_numpy(), SLICE):
                each = [hashes(raw, words) for raw in texts.slice(a, b - a).to_pylist()]
                flat = np.fromiter((h for one in each for h in one), np.uint64)
                found.append(majority(flat, np.fromiter(map(len, each), np.int64, len(each))))
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *more])

    return docs.select("doc_id", "text", *more).mapInArrow(frugal(run), "doc_id long, fp long" + ", row long" * len(more))


def apart(points: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ point)


def cut_at(points: np.ndarray, vantage: np.uint64) -> tuple[np.ndarray, int] | None:
    """Distances from the vantage point and the cut that halves the points best; None if all are at one distance."""
    d = apart(points, vantage).astype(np.int64)
    below = np.cumsum(np.bincount(d, minlength=65))
    usable = np.flatnonzero((below > 0) & (below < len(points)))
    return (d, int(usable[np.abs(below[usable] - len(points) / 2).argmin()])) if len(usable) else None


def build(sample: np.ndarray, leaf: float, radius: int) -> list[tuple[int, int, int, int]]:
    """The top of the tree as nodes (vantage point, cut, inside, outside); a child below 0 is shard -child - 1."""
    nodes: list[tuple[int, int, int, int]] = []
    shards = 0

    def grow(points: np.ndarray) -> int:
        nonlocal shards
        got = cut_at(points, points[len(points) // 2]) if len(points) > max(leaf, 8) else None
        if got is None or not worth(int((got[0] <= got[1]).sum()), int((got[0] > got[1] - radius).sum()), len(points)):
            shards += 1
            return -shards
        d, cut = got
        at = len(nodes)
        nodes.append((0, 0, 0, 0))
        inside, outside = grow(points[d <= cut]), grow(points[d > cut])
        nodes[at] = (int(points[len(points) // 2]), cut, inside, outside)
        return at

    grow(sample)
    return nodes


def route(points: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) of each point's shard and of those whose boundary it overlaps."""
    rows, shards = [], []

    def go(at: int, who: np.ndarray) -> None:
        if at < 0 or not nodes:
            rows.append(who)
            shards.append(np.full(len(who), max(-at - 1, 0), np.int32))
        elif len(who):
            vantage, cut, inside, outside = nodes[at]
            d = apart(points[who], np.uint64(vantage)).astype(np.int64)
            go(inside, who[d <= cut])
            go(outside, who[d > cut - radius])

    go(0, np.arange(len(points)))
    return np.concatenate(rows), np.concatenate(shards)


class Forest:
    """Union-find over positions, with every position's tree at hand for whole blocks of links."""

    def __init__(self, n: int):
        self.tree = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.tree[a], self.tree[b]
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)])[:, x != y], axis=1)
        if not pairs.shape[1]:
            return
        up: dict[int, int] = {}

        def find(v: int) -> int:
            while (w := up.get(v, v)) != v:
                up[v] = up.get(w, w)
                v = w
            return v

        for v, w in pairs.T.tolist():
            v, w = find(v), find(w)
            if v != w:
                up[max(v, w)] = min(v, w)
        into = np.arange(len(self.tree))
        for v in up:
            into[v] = find(v)
        self.tree = into[self.tree]


def worth(inside: int, outside: int, n: int) -> bool:
    """Whether two overlapping parts cost less than the whole; points in one small ball can't be dealt apart."""
    return inside**2 + outside**2 <= 0.8 * n**2


def join_shard(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (member, root) of the links within radius among distinct points."""
    forest = Forest(len(points))
    todo = [np.arange(len(points))]
    while todo:
        who = todo.pop()
        got = cut_at(points[who], points[who[len(who) // 2]]) if len(who) > BLOCK else None
        if got is not None:
            d, cut = got
            inside, outside = who[d <= cut], who[d > cut - radius]
            if worth(len(inside), len(outside), len(who)):
                todo += [inside, outside]
                continue
        for at in range(0, len(who), 512):
            i, j = np.nonzero(np.bitwise_count(points[who[at : at + 512], None] ^ points[None, who[at:]]) <= radius)
            forest.add(who[at + i], who[at + j])
    members = np.flatnonzero(forest.tree != np.arange(len(points)))
    return points[members], points[forest.tree[members]]


def links(distinct: DataFrame, radius: int, n: int) -> DataFrame:
    """(a, b) of a spanning forest of each shard's links; distinct(fp) holds no fingerprint twice; n: its rows."""
    order = F.xxhash64("fp")
    sample = np.array([r[0] for r in distinct.orderBy(order, "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    shards = min(SHARDS, max(1, n // SHARD))
    nodes = build(sample, len(sample) / shards, radius) if shards > 1 else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = batch.column(0).to_numpy()
            row, shard = route(fp.view(np.uint64), nodes, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp[row])], ["shard", "fp"])

    def join(group: pa.Table) -> pa.Table:
        points = np.unique(group.column("fp").to_numpy()).view(np.uint64)
        a, b = join_shard(points, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return distinct.select("fp").mapInArrow(frugal(deal), "shard int, fp long").groupBy("shard").applyInArrow(frugal_group(join), "a long, b long")


def grouped(marked: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """(fp, group, component_id) of the distinct fingerprints of marked(doc_id, fp)."""
    distinct = scratch.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(distinct, radius, distinct.count()), scratch)
    joined = scratch.keep(found.join(distinct, F.col("node") == F.col("fp")).select("node", "component", "least"))
    least = joined.groupBy("component").agg(F.min("least").alias("low"))
    named = joined.join(least, "component").select(F.col("node").alias("fp"), "component", "low")
    return distinct.join(named, "fp", "left").select("fp", F.coalesce("component", "fp").alias("group"), F.coalesce("low", "least").alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of docs(doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.keep(fingerprints(docs.select("doc_id", "text"), words))
    every = scratch.keep(grouped(marked, radius, scratch))  # written first, so that AQE may split a fingerprint of very many texts
    return marked.join(every, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_prints(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of WIDE words of each run of sizes hashes: of the hashes, and of what a mixer makes of them for each further word."""
    out = [majority(values, sizes)]
    for k in range(1, WIDE):
        mixed = values + np.uint64(k * 0x9E3779B97F4A7C15 & 2**64 - 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        out.append(majority(mixed ^ (mixed >> np.uint64(31)), sizes))
    return np.stack(out, 1)


def signed(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, row, k1, k2, n, fp) of docs(doc_id, text, row): a 128-bit name, the size and the wide fingerprint of the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
            for a, b in byte_slices(pc.binary_length(texts).to_numpy(), SLICE):
                each = [shingles(raw, words) for raw in texts.slice(a, b - a).to_pylist()]
                sizes = np.array([len(e) for e in each], np.int64)
                prints = [p.tobytes() for p in wide_prints(np.concatenate(each), sizes)]
                name = np.frombuffer(b"".join(xxhash.xxh3_128_digest(e.tobytes()) for e in each), np.int64).reshape(-1, 2)
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([own.column(0).cast(pa.int64()), own.column(2), pa.array(name[:, 0].copy()), pa.array(name[:, 1].copy()), pa.array(sizes), pa.array(prints, pa.binary())], ["doc_id", "row", "k1", "k2", "n", "fp"])

    return docs.select("doc_id", "text", "row").mapInArrow(frugal(run), "doc_id long, row long, k1 long, k2 long, n long, fp binary")


def print_bytes(column: pa.Array) -> np.ndarray:
    """The fingerprints of a binary column, a row of WIDE words each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WIDE)


def wide_apart(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.bitwise_count(points ^ point).sum(1, dtype=np.int64)


def wide_tree(sample: np.ndarray, leaf: float, radius: int) -> list[tuple[np.ndarray, int, int, int]]:
    """The top of the tree as build() has it. Of some vantage points the one and the cut whose overlapping parts cost least; they often are worth nothing here."""
    nodes: list[tuple[np.ndarray, int, int, int]] = []
    shards = 0

    def grow(points: np.ndarray) -> int:
        nonlocal shards
        best = None
        for at in range(0, len(points), max(1, len(points) // 8)) if len(points) > max(leaf, 8) else ():
            d = wide_apart(points, points[at])
            below = np.cumsum(np.bincount(d, minlength=64 * WIDE + 1))
            outside = len(points) - np.concatenate([np.zeros(min(radius, len(below)), np.int64), below])[: len(below)]
            cost = np.where((below < len(points)) & (outside < len(points)), below**2 + outside**2, len(points) ** 2)
            cut = int(cost.argmin())
            if worth(int(below[cut]), int(outside[cut]), len(points)) and (best is None or cost[cut] < best[0]):
                best = (cost[cut], points[at], d, cut)
        if best is None:
            shards += 1
            return -shards
        _, vantage, d, cut = best
        at = len(nodes)
        nodes.append((vantage, cut, 0, 0))
        nodes[at] = (vantage, cut, grow(points[d <= cut]), grow(points[d > cut - radius]))
        return at

    grow(sample)
    return nodes


def wide_route(points: np.ndarray, nodes: list[tuple[np.ndarray, int, int, int]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) as route() has it."""
    rows, shards = [], []

    def go(at: int, who: np.ndarray) -> None:
        if at < 0 or not nodes:
            rows.append(who)
            shards.append(np.full(len(who), max(-at - 1, 0), np.int32))
        elif len(who):
            vantage, cut, inside, outside = nodes[at]
            d = wide_apart(points[who], vantage)
            go(inside, who[d <= cut])
            go(outside, who[d > cut - radius])

    go(0, np.arange(len(points)))
    return np.concatenate(rows), np.concatenate(shards)


def join_lots(sides: list[tuple[np.ndarray, np.ndarray]], radius: int, similarity: float) -> np.ndarray:
    """The tree of each point, after those of two sides(prints, sizes), or of one, that are within radius and may be similar by their sizes are joined."""
    orders = [np.argsort(n, kind="stable") for _, n in sides]
    prints = [np.ascontiguousarray(p[o].T) for (p, _), o in zip(sides, orders, strict=True)]
    sizes = [n[o] for (_, n), o in zip(sides, orders, strict=True)]
    base = len(sizes[0]) if len(sides) > 1 else 0
    forest = Forest(base + len(sizes[-1]))
    words = np.empty((TILE, WIDTH), np.uint64)
    bits, more = np.empty((2, TILE, WIDTH), np.uint8)
    for top in range(0, len(sizes[0]), TILE):
        n, rows = sizes[0][top : top + TILE], prints[0][:, top : top + TILE]
        low = np.searchsorted(sizes[-1], n[0] * similarity - 1e-6)
        high = np.searchsorted(sizes[-1], n[-1] / similarity + 1e-6, "right")
        for left in range(low if base else max(low, top), high, WIDTH):
            columns = prints[-1][:, left : min(left + WIDTH, high)]
            shape = np.s_[: len(n), : columns.shape[1]]
            x, d, e = words[shape], bits[shape], more[shape]
            np.bitwise_count(np.bitwise_xor(rows[0][:, None], columns[0], out=x), out=d)
            np.bitwise_count(np.bitwise_xor(rows[1][:, None], columns[1], out=x), out=e)
            i, j = np.nonzero(np.add(d, e, out=d) <= HALF)
            while len(i):  # a pair for each row and column at once, until none is left between trees: dense groups never list their pairs
                between = forest.tree[top + i] != forest.tree[base + left + j]
                i, j = i[between], j[between]
                m = sizes[-1][left + j]
                near = (np.minimum(n[i], m) >= similarity * np.maximum(n[i], m) - 1e-6) & (np.bitwise_count(rows[:, i] ^ columns[:, j]).sum(0, dtype=np.int64) <= radius)
                i, j = i[near], j[near]
                first = np.concatenate([np.full(TILE, -1), np.full(WIDTH, -1)])
                first[i], first[TILE + j] = np.arange(len(i)), np.arange(len(j))
                picked = first[first >= 0]
                forest.add(top + i[picked], base + left + j[picked])
    back = np.concatenate([orders[0], base + orders[1]]) if base else orders[0]
    out = np.empty(len(back), np.int64)
    out[back] = back[forest.tree]
    return out


def close_prints(points: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b) of spanning forests over the points(uid, n, fp) whose fingerprints are within REACH and whose sizes allow the similarity."""
    points = points.select("uid", "n", "fp").filter(F.col("n") / (F.col("n") + 1) >= similarity - 1e-9)  # the others are similar to none but their equals
    total = points.count()
    sample = [bytes(r[0]) for r in points.orderBy(F.xxhash64("uid"), "uid").select("fp").limit(SAMPLE).collect()]
    shards, block = min(SHARDS, max(1, total // SHARD)), max(SHARD, total // LOTS)
    nodes = wide_tree(np.frombuffer(b"".join(sample), np.uint64).reshape(-1, WIDE), len(sample) / shards, REACH) if shards > 1 else []
    step = -np.log(similarity) / 2  # levels of sizes: similar sets are at most two apart, three by rounding

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, shard = wide_route(print_bytes(batch.column(2)), nodes, REACH)
                some = batch.take(pa.array(row))
                level = np.floor(np.log(some.column(1).to_numpy()) / step).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(level), *some.columns], ["shard", "level", "uid", "n", "fp"])

    dealt = scratch.keep(points.mapInArrow(frugal(deal), "shard int, level int, uid long, n long, fp binary"))
    counts: dict[int, dict[int, int]] = {}
    for shard, level, n in dealt.groupBy("shard", "level").count().collect():
        counts.setdefault(shard, {})[level] = n
    lots = {s: {k: -(-n // block) for k, n in own.items()} for s, own in counts.items() if sum(own.values()) > block}

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, level, uid = (batch.column(i).to_numpy() for i in range(3))
            lot = ((uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            for s, k in sorted(set(zip(shard.tolist(), level.tolist(), strict=True))):
                mine = np.flatnonzero((shard == s) & (level == k))
                if s not in lots:
                    yield placed(batch, mine, s, 0, 0, 0, 0, 0)
                    continue
                own = lots[s]
                for x in range(own[k]):
                    who = mine[lot[mine] % own[k] == x]
                    if not len(who):
                        continue
                    for other in range(k - 3, k + 4):
                        for y in range(own.get(other, 0)):
                            first = (k, x) <= (other, y)
                            yield placed(batch, who, s, *((k, x, other, y, 0) if first else (other, y, k, x, 1)))

    def placed(batch: pa.RecordBatch, who: np.ndarray, *place: int) -> pa.RecordBatch:
        some = batch.select(["uid", "n", "fp"]).take(pa.array(who))
        return pa.RecordBatch.from_arrays([*(pa.array(np.full(len(who), v, np.int32)) for v in place), *some.columns], [*MEETING, "side", "uid", "n", "fp"])

    def join(group: pa.Table) -> pa.Table:
        side, uid = group.column("side").to_numpy(), group.column("uid").to_numpy()
        prints, n = print_bytes(group.column("fp")), group.column("n").to_numpy()
        i, x, j, y = (group.column(c)[0].as_py() for c in MEETING[1:])
        rows = [np.flatnonzero(side == k) for k in (0, 1)] if (i, x) != (j, y) else [np.arange(len(uid))]
        tree, uid = join_lots([(prints[r], n[r]) for r in rows], REACH, similarity), uid[np.concatenate(rows)]
        joined = np.flatnonzero(tree != np.arange(len(tree)))
        return pa.table({"a": uid[joined], "b": uid[tree[joined]]})

    met = dealt.mapInArrow(frugal(meetings), ", ".join(f"{c} int" for c in [*MEETING, "side"]) + ", uid long, n long, fp binary")
    return met.groupBy(*MEETING).applyInArrow(frugal_group(join), "a long, b long")


def shingles(raw: bytes, words: int) -> np.ndarray:
    """The set of a text's hashed shingles, sorted."""
    return np.unique(np.array(hashes(raw, words), np.uint64))


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(uid, hashes) of docs(uid, text): the sorted hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
            for a, b in byte_slices(pc.binary_length(texts).to_numpy(), SLICE):
                found = [shingles(raw, words).tobytes() for raw in texts.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, pa.binary())], ["uid", "hashes"])

    return docs.select("uid", "text").mapInArrow(frugal(run), "uid long, hashes binary")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs(a, b) whose sets have a Jaccard similarity of at least similarity, computed from the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                stay.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))

    left = sets.select(F.col("uid").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("uid").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(frugal(run), "a long, b long")


def similar_sets(points: DataFrame, texts: DataFrame, words: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(node, component) of the points(uid, n, fp) with links of at least similarity; texts(uid, text)."""
    forest = scratch.keep(close_prints(points, similarity, scratch))
    close = components(forest, scratch)
    own = close.select(F.col("component").alias("key"), F.col("node").alias("uid"), F.col("component").alias("pivot"))
    member = scratch.keep(own.join(points.select("uid", "n"), "uid").select("key", "uid", "n", "pivot"))
    sets = scratch.keep(shingle_sets(texts.join(member.select("uid"), "uid", "left_semi"), words))
    links = scratch.keep(verified(member.filter("uid <> pivot").select(F.col("pivot").alias("a"), F.col("uid").alias("b")).distinct(), sets, similarity))

    for turn in range(PIVOTS + 1):
        named = member.join(components(links, scratch).withColumnRenamed("node", "uid"), "uid", "left").select("key", "uid", "n", F.coalesce("component", "uid").alias("c"))
        named = scratch.keep(named)
        mixed = named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min_by("uid", F.xxhash64("uid", F.lit(turn))).alias("pivot")).filter("low <> high")
        inside = scratch.keep(named.join(mixed.select("key", "pivot"), "key"))
        if turn == PIVOTS:  # members of groups that are still of several components
            links = links.unionByName(scratch.keep(exact_links(inside.select("key", "uid", "n", "c"), sets, similarity, scratch)))
        else:  # one more member of a group meets all others: one row a member
            far = (F.col("c") != F.col("ac")) & (F.least("n", "an") >= similarity * F.greatest("n", "an") - 1e-9)
            own = inside.filter("uid = pivot").select("key", F.col("uid").alias("a"), F.col("n").alias("an"), F.col("c").alias("ac"))
            pairs = own.join(inside, "key").filter(far).select(F.least("a", "uid").alias("a"), F.greatest("a", "uid").alias("b")).distinct()
            links = links.unionByName(scratch.keep(verified(pairs, sets, similarity)))
        scratch.drop(named, inside)
    scratch.drop(member, sets)
    return components(links, scratch)


def exact_links(members: DataFrame, sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b) of forests that join the components c of members(key, uid, n, c) of a group, key, wherever two of their sets are similar."""
    lots = scratch.keep(members.groupBy("key").agg(F.ceil(F.sum("n") / LOT).cast("int").alias("lots")))
    placed = members.join(lots, "key")
    if not lots.filter("lots > 1").isEmpty():  # sets of large groups are dealt out several times: those that share none of their rarest shingles with another component stay out
        shared = prefixes(placed.filter("lots > 1").select("uid", "n", "c"), sets, similarity, scratch)
        meets = scratch.keep(shared.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("key"))
        stay = scratch.keep(shared.join(meets, "key").select("uid").distinct())
        placed = placed.filter("lots <= 1").unionByName(placed.filter("lots > 1").join(stay, "uid", "left_semi").select(placed.columns))
    x, y = F.pmod(F.xxhash64("uid"), F.col("lots")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1))
    dealt = placed.join(sets, "uid").select("key", "uid", "c", "hashes", x.alias("x"), y.alias("y"))
    dealt = dealt.select("key", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), (F.col("x") > F.col("y")).alias("side"), "uid", "c", "hashes")

    def join(group: pa.Table) -> pa.Table:
        found = [np.frombuffer(h, np.uint64) for h in group.column("hashes").to_pylist()]
        side = group.column("side").to_numpy() if group.column("i")[0].as_py() != group.column("j")[0].as_py() else None
        a, b = join_sets(found, group.column("c").to_numpy(), side, similarity)
        uid = group.column("uid").to_numpy()
        return pa.table({"a": uid[a], "b": uid[b]})

    return dealt.groupBy("key", "i", "j").applyInArrow(frugal_group(join), "a long, b long")


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the runs of sizes from starts on."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def join_sets(sets: list[np.ndarray], c: np.ndarray, side: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of a forest that joins components c with similar sets; with side, only sets of different sides are compared.

    Similar sets share one of the rarest shingles of each, all but similarity of them; the sets that share one are compared whole.
    """
    none = np.zeros(0, np.int64)
    if len(sets) < 2 or (c == c[0]).all() or (side is not None and (side == side[0]).all()):
        return none, none
    n = np.array([len(s) for s in sets], np.int64)
    _, ids, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(count, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    first = int((count == 1).sum())  # shingles of one set come first in the order and are left out
    row, ids = np.repeat(np.arange(len(sets)), n), rank[ids] - first
    row, ids = row[ids >= 0], ids[ids >= 0]
    order = np.argsort(row * len(rank) + ids)
    row, ids = row[order], ids[order]
    size = np.bincount(row, minlength=len(sets))
    start = np.cumsum(size) - size
    room = np.clip(n - np.ceil(n * similarity - 1e-9).astype(np.int64) + 1 - (n - size), 0, size)
    rarest = ranges(start, room)
    by = rarest[np.argsort(ids[rarest], kind="stable")]
    length = np.bincount(ids[by], minlength=len(rank) - first)
    begin, owner = np.cumsum(length) - length, row[by]

    _, roots, tree = np.unique(c, return_index=True, return_inverse=True)
    forest, marked = Forest(len(roots)), np.zeros(len(rank) - first, bool)
    for k in np.flatnonzero(room) if side is None else np.flatnonzero(room & -side.astype(np.int64)):
        own = ids[start[k] : start[k] + room[k]]
        met = np.unique(owner[ranges(begin[own], length[own])])
        met = met[met < k] if side is None else met[~side[met]]
        met = met[np.minimum(n[met], n[k]) >= similarity * np.maximum(n[met], n[k]) - 1e-9]
        met = met[forest.tree[tree[met]] != forest.tree[tree[k]]]
        if not len(met):
            continue
        marked[ids[start[k] : start[k] + size[k]]] = True
        while len(met):
            some = met[: max(1, int(np.searchsorted(np.cumsum(size[met]), CHECKED)))]
            both = np.add.reduceat(marked[ids[ranges(start[some], size[some])]], np.cumsum(size[some]) - size[some], dtype=np.int64)
            near = some[both >= similarity * (n[some] + n[k] - both) - 1e-9]
            forest.add(tree[near], np.full(len(near), tree[k]))
            met = met[len(some) :]
            met = met[forest.tree[tree[met]] != forest.tree[tree[k]]]
        marked[ids[start[k] : start[k] + size[k]]] = False
    joined = np.flatnonzero(forest.tree != np.arange(len(roots)))
    return roots[joined], roots[forest.tree[joined]]


def prefixes(points: DataFrame, sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(key, uid, n, c, rest) of the shingles of each of points(uid, n, c) that a similar set must share one of: its rarest ones, all but similarity of them.

    rest: how many of its shingles stand from this one on in the order.

    Two sets of at least similarity share a shingle among these, whatever order is taken for all; with the rarest first, a passage that many texts share brings none of
    them together. Shingles of one set only come first in the order and never meet; the others are counted before they are dealt out.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(3)).to_numpy()
            for a, b in byte_slices(sizes, SLICE):
                some, n = batch.slice(a, b - a), sizes[a:b] // 8
                flat = np.frombuffer(b"".join(some.column(3).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(some.column(i).to_numpy(), n)) for i in range(3)), pa.array(flat)], ["uid", "n", "c", "key"])

    every = scratch.keep(points.join(sets, "uid").select("uid", "n", "c", "hashes").mapInArrow(frugal(listed), "uid long, n long, c long, key long"))
    common = scratch.keep(every.groupBy("key").count().filter("count > 1"))
    met = every.join(common, "key")
    ordered = met.groupBy("uid", "n", "c").agg(F.array_sort(F.collect_list(F.struct("count", "key"))).alias("keys"))
    # ceil(similarity * n) of n have to be shared, so that one of the first n - that + 1 is; n - size(keys) stand in this set only.
    room = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1 - (F.col("n") - F.size("keys"))
    chosen = ordered.withColumn("room", room.cast("int")).filter("room > 0").select("uid", "n", "c", F.size("keys").alias("common"), F.posexplode(F.slice("keys", 1, F.col("room"))).alias("place", "k"))
    return chosen.select("k.key", "uid", "n", "c", (F.col("common") - F.col("place")).cast("long").alias("rest"))


def representatives(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs with one row of each group of near copies left: that of the smallest id (nulls last), the first of repeated rows.

    Near copies are texts whose sets of shingles have a Jaccard similarity of at least similarity. docs has to be read from files (or be as
    steady), as its rows are numbered twice.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    row = fresh(docs, "row_number")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    marked = scratch.keep(signed(numbered.select("doc_id", "text", F.col(row).alias("row")), words))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("first")
    # Equal sets are one point, named by its least row: a set of a third of all rows is one row before the joins.
    each = marked.groupBy("k1", "k2").agg(first, F.first("n").alias("n"), F.first("fp").alias("fp"))
    points = scratch.keep(each.select(F.col("first.row").alias("uid"), "first", "n", "fp"))
    scratch.drop(marked)
    found = similar_sets(points.select("uid", "n", "fp"), numbered.select(F.col(row).alias("uid"), "text"), words, similarity, scratch)
    group = points.join(found.withColumnRenamed("node", "uid"), "uid", "left").groupBy(F.coalesce("component", "uid"))
    stay = scratch.keep(group.agg(F.min("first").alias("first")).select(F.col("first.row").alias(row)))
    scratch.clear(stay)
    return numbered.join(stay, row, "left_semi").drop(row)

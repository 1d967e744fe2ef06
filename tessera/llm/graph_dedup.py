"""Near-duplicate embeddings within a label, by robust-pruned graphs over overlapping clusters.

Equal vectors of a label are one point with a number of copies. A label with over CELL points gets medoids, well-separated points of a
bounded sample; each point is a query in the cell of its nearest medoid, and a member of every cell whose medoid's angle is within
the nearest angle plus twice the link angle. By the triangle inequality no link is lost between cells, whatever the medoids are. Where vectors
are spread evenly in many dimensions that is most cells, and the work grows with the square of a label. A cell of over 2 * CELL members is dealt
into blocks by hash, and each block of members meets each block of queries.

In a task: members are clustered again with overlap, in each cluster the nearest candidates of each point are robust-pruned
(a candidate goes if a kept neighbour is nearer to it by the factor ALPHA), the clusters' adjacency lists are united, with
reverse edges. Each query walks greedily from the medoids, then expands every point within range until no new one is in range. Cosines
are computed in double precision, so what is found is verified. AUDIT queries are held against all members; where they have fewer than TRUE
links (a point's own copy is none) or less than RECALL of them are found, the task compares its queries with all members instead. A task returns link counts and a spanning forest, never pairs.

Vectors that are null, empty, zero, or hold null or non-finite components, and those without a label, link with nothing: 0 links,
own component. Vectors of different lengths never link. Null ids are kept (not kept = true); repeated rows are copies. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components
from .simhash import Forest

#: Points of a cell, most medoids of all labels, cosine at which two medoids are too near each other, rows dealt at once.
CELL, MEDOIDS, APART, DEALT = 4_000, 32_768, 0.8, 16_384
#: Points of a cluster in a task, candidates and neighbours of a point, the pruning factor, hops of the greedy walk, queries at once.
CLUSTER, CANDIDATES, DEGREE, ALPHA, HOPS, QUERIES = 500, 48, 24, 1.2, 12, 256
#: How much wider than the link angle the walk's range is.
WIDER = 1.15
#: Audited queries of a task, the share of their links to find, links that an audit has to hold at least.
AUDIT, RECALL, TRUE = 48, 0.99, 100


def separated(points: np.ndarray, most: int) -> np.ndarray:
    """Places of up to most points, none nearer than APART to one before it; the first always."""
    chosen = [0]
    near = points @ points[0]
    for i in range(1, len(points)):
        if len(chosen) == most:
            break
        if near[i] < APART:
            chosen.append(i)
            near = np.maximum(near, points @ points[i])
    return np.array(chosen)


def nearest(points: np.ndarray, medoids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest medoids of each point, nearest first."""
    near = points @ medoids.T
    return np.argsort(-near, axis=1, kind="stable")[:, :k]


def cells_of(points: np.ndarray, medoids: np.ndarray, cosine: float) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(point, cell) of all cells in which a query may link to the point, and whether it is the point's own."""
    angle = np.arccos(np.clip(points @ medoids.T, -1, 1))
    own = angle.argmin(1)
    pairs = np.nonzero(angle <= angle.min(1, keepdims=True) + 2 * np.arccos(cosine) + 1e-6)
    return pairs, own[pairs[0]] == pairs[1]


def pruned(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the robust-pruned neighbours among points."""
    n = len(points)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = points @ points.T
    np.fill_diagonal(near, -np.inf)
    k = min(CANDIDATES, n - 1)
    cand = np.argpartition(-near, k - 1, axis=1)[:, :k]
    own = np.take_along_axis(near, cand, 1)
    order = np.argsort(-own, axis=1)
    cand, own = np.take_along_axis(cand, order, 1), np.take_along_axis(own, order, 1)
    far = np.sqrt(np.maximum(2 - 2 * own, 0))
    alive, rows = np.ones(cand.shape, bool), np.arange(n)
    source, target = [], []
    for _ in range(min(DEGREE, k)):
        first = alive.argmax(1)
        who = np.flatnonzero(alive[rows, first])
        if not len(who):
            break
        pick = cand[who, first[who]]
        source.append(who)
        target.append(pick)
        between = np.sqrt(np.maximum(2 - 2 * near[pick[:, None], cand[who]], 0))
        alive[who] &= ALPHA * between > far[who]
        alive[who, first[who]] = False
    return np.concatenate(source), np.concatenate(target)


def graph(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets and targets of the united adjacency lists, and the medoids that walks start from."""
    starts = separated(points, max(1, -(-len(points) // CLUSTER)) * 2)
    member = nearest(points, points[starts], min(2, len(starts)))
    edges = [np.zeros(0, np.int64)]
    for c in range(len(starts)):
        who = np.flatnonzero((member == c).any(1))
        for at in range(0, len(who), 4 * CLUSTER):  # a tight group makes large clusters
            some = np.concatenate([[starts[c]], who[at : at + 4 * CLUSTER]]) if at else who[: 4 * CLUSTER]
            some = np.unique(some)
            a, b = pruned(points[some])
            a, b = some[a], some[b]
            edges += [a * len(points) + b, b * len(points) + a]
    edges.append(starts * len(points) + np.roll(starts, 1))
    both = np.unique(np.concatenate(edges))
    a, b = both // len(points), both % len(points)
    offsets = np.searchsorted(a, np.arange(len(points) + 1))
    return offsets, b, starts


def expand(rows: np.ndarray, nodes: np.ndarray, offsets: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, neighbour) of each (row, node)."""
    sizes = offsets[nodes + 1] - offsets[nodes]
    first = np.repeat(offsets[nodes] - (np.cumsum(sizes) - sizes), sizes)
    return np.repeat(rows, sizes), targets[first + np.arange(sizes.sum())]


def search(queries: np.ndarray, points: np.ndarray, built: tuple, cosine: float, same: np.ndarray) -> np.ndarray:
    """(query, point) flags of the points that a range-expanding walk finds at cosine or more.

    A query that is one of the points starts there as well. The range that is expanded is wider than the one that is asked for by the factor WIDER in angle, as points on
    its edge may have no neighbour inside.
    """
    offsets, targets, starts = built
    score = np.full((len(queries), len(points)), -np.inf)
    open_ = np.zeros(score.shape, bool)
    score[:, starts] = queries @ points[starts].T
    open_[:, starts] = True
    every = np.arange(len(queries))
    placed = np.flatnonzero(same >= 0)
    score[placed, same[placed]], open_[placed, same[placed]] = 1, True
    reach = np.cos(min(np.pi, WIDER * np.arccos(cosine)))

    def visit(rows: np.ndarray, nodes: np.ndarray) -> None:
        open_[rows, nodes] = False
        r, n = expand(rows, nodes, offsets, targets)
        new = np.isneginf(score[r, n])
        flat = np.unique(r[new] * len(points) + n[new])
        r, n = flat // len(points), flat % len(points)
        for a in range(0, len(r), 65_536):
            x, y = r[a : a + 65_536], n[a : a + 65_536]
            score[x, y] = np.einsum("ij,ij->i", queries[x], points[y])
        open_[r, n] = True

    for _ in range(HOPS):
        best = np.where(open_, score, -np.inf).argmax(1)
        live = open_[every, best]
        if not live.any():
            break
        visit(every[live], best[live])
    while True:
        rows, nodes = np.nonzero(open_ & (score >= reach))
        if not len(rows):
            return score >= cosine
        visit(rows, nodes)


def link(points: np.ndarray, copies: np.ndarray, queries: np.ndarray, same: np.ndarray, cosine: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Linked copies of each query, and (tree of each point, then of each query). same: each query's place among the points, or -1."""
    counts, forest = np.zeros(len(queries), np.int64), Forest(len(points) + len(queries))
    placed = np.flatnonzero(same >= 0)
    forest.add(len(points) + placed, same[placed])
    audit = np.random.default_rng(seed).permutation(len(queries))[:AUDIT]
    true = queries[audit] @ points.T >= cosine
    own = np.flatnonzero(same[audit] >= 0)
    true[own, same[audit][own]] = False
    exact = bool(true.sum() < TRUE)
    if not exact:
        built = graph(points)
        exact = bool((search(queries[audit], points, built, cosine, same[audit]) & true).sum() < RECALL * true.sum())
    for at in range(0, len(queries), QUERIES):
        some = queries[at : at + QUERIES]
        own = same[at : at + QUERIES]
        hits = some @ points.T >= cosine if exact else search(some, points, built, cosine, own)
        who = np.flatnonzero(own >= 0)
        hits[who, own[who]] = False
        counts[at : at + QUERIES] = hits @ copies
        q, p = np.nonzero(hits)
        forest.add(len(points) + at + q, p)
    return counts, forest.tree


def unit(batch_column: pa.Array) -> np.ndarray:
    raw = np.stack([np.asarray(x, np.float64) for x in batch_column.to_pylist()])
    raw /= np.abs(raw).max(1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors(vec_id, embedding, label)."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "vectors")
    numbers = F.expr("transform(embedding, x -> cast(x as double))")
    bad = F.expr("exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf')) or not exists(embedding, x -> x <> 0)")
    usable = F.coalesce(F.col("embedding").isNotNull() & F.col("label").isNotNull() & ~bad, F.lit(False))
    clean = F.expr("transform(embedding, x -> if(x = 0, x * 0, x))")
    rows = vectors.select("vec_id", "label", F.when(usable, clean).alias("embedding"))
    keyed = rows.withColumns({"k1": F.xxhash64("label", "embedding"), "k2": F.xxhash64(F.lit(1), "embedding", "label")})
    group = keyed.filter("embedding is not null").groupBy("label", "k1", "k2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    points = scratch.keep(group.select(F.monotonically_increasing_id().alias("uid"), "label", F.size("embedding").alias("dim"), "k1", "k2", "copies", "least", numbers.alias("embedding")))

    sizes = {(r[0], r[1]): r[2] for r in points.groupBy("label", "dim").count().filter(F.col("count") > CELL).collect()}
    cell = max(CELL, sum(sizes.values()) // MEDOIDS)
    wanted = {k: -(-n // cell) for k, n in sizes.items() if n > cell}
    medoids: dict[tuple, np.ndarray] = {}
    if wanted:
        share = min(1.0, 8 / cell)
        sample = points.filter(F.col("label").isin([k[0] for k in wanted]) & (F.pmod(F.xxhash64("uid", "k1"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)).select("label", "dim", "embedding", F.xxhash64("k1").alias("o")).collect()
        for key, n in wanted.items():
            own = [r[2] for r in sorted((r for r in sample if (r[0], r[1]) == key), key=lambda r: r[3])]
            if own:
                some = unit(pa.array(own))
                medoids[key] = some[separated(some, n)]

    kind = dict(points.dtypes)["label"]
    schema = f"uid long, label {kind}, dim int, cell int, home boolean, copies long, embedding array<double>"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            labels, dims = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            row, cells, home = [], [], []
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(labels, dims, strict=True)):
                groups.setdefault(key, []).append(i)
            for key, who in groups.items():
                if key not in medoids:
                    row.append(np.array(who))
                    cells.append(np.zeros(len(who), np.int64))
                    home.append(np.ones(len(who), bool))
                    continue
                step = max(1, (1 << 22) // len(medoids[key]))
                for at in range(0, len(who), step):
                    some = np.array(who[at : at + step])
                    own, c = cells_of(unit(batch.column(4).take(pa.array(some))), medoids[key], cosine)
                    row.append(some[own[0]])
                    cells.append(own[1])
                    home.append(c)
            row, cells, home = np.concatenate(row), np.concatenate(cells), np.concatenate(home)
            for at in range(0, len(row), DEALT):
                some, to = batch.take(pa.array(row[at : at + DEALT])), slice(at, at + DEALT)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array(cells[to], pa.int32()), pa.array(home[to]), some.column(3), some.column(4)], ["uid", "label", "dim", "cell", "home", "copies", "embedding"])

    dealt = scratch.keep(points.select("uid", "label", "dim", "copies", "embedding").mapInArrow(deal, schema))
    blocks = [F.greatest(F.lit(1), F.ceil(n / CELL)).cast("int").alias(k) for k, n in (("ms", F.count("*")), ("qs", F.sum(F.col("home").cast("int"))))]
    large = dealt.groupBy("label", "dim", "cell").agg(*blocks).filter("ms > 2")
    cut = dealt.join(large, ["label", "dim", "cell"], "left").withColumns({k: F.coalesce(k, F.lit(1)) for k in ("ms", "qs")}).withColumn("h", F.xxhash64("uid"))
    points_of = "transform(sequence(0, qs - 1), i -> struct(cast(pmod(h, ms) as int) as point, i as query, true as member))"
    queries_of = "transform(sequence(0, ms - 1), i -> struct(i as point, cast(pmod(h, qs) as int) as query, false as member))"
    sides = F.explode(F.expr(f"if(home, concat({points_of}, {queries_of}), {points_of})")).alias("s")
    tasks = cut.select("uid", "label", "dim", "cell", "copies", "embedding", sides).select("uid", "label", "dim", "cell", "copies", "embedding", "s.point", "s.query", "s.member")

    def work(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("uid")
        member = group.column("member").to_numpy()
        uid, copies = group.column("uid").to_numpy(), group.column("copies").to_numpy()
        at, ask = np.flatnonzero(member), np.flatnonzero(~member)
        if not len(at) or not len(ask):
            return pa.table({"uid": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        both = unit(group.column("embedding").combine_chunks())
        place = np.searchsorted(uid[at], uid[ask]).clip(max=len(at) - 1)
        same = np.where(uid[at][place] == uid[ask], place, -1)
        counts, tree = link(both[at], copies[at], both[ask], same, cosine)
        named = np.concatenate([uid[at], uid[ask]])
        links = np.concatenate([np.zeros(len(at), np.int64), counts])
        told = (named != named[tree]) | (links > 0)
        return pa.table({"uid": named[told], "links": links[told], "root": named[tree][told]})

    told = scratch.keep(tasks.groupBy("label", "dim", "cell", "point", "query").applyInArrow(work, "uid long, links long, root long"))
    counts = told.groupBy("uid").agg(F.sum("links").alias("links"))
    found = components(told.select(F.col("uid").alias("a"), F.col("root").alias("b")), scratch)
    named = points.select("uid", "label", "k1", "k2", "copies", "least").join(counts, "uid", "left").join(found.withColumnRenamed("node", "uid"), "uid", "left")
    named = scratch.keep(named.select("k1", "k2", "label", "least", F.coalesce("component", "uid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    low = named.groupBy("component").agg(F.min("least").alias("component_id"))
    every = named.join(low, "component").select("k1", "k2", "label", "n_links", "component_id")
    out = keyed.select("vec_id", "label", F.when(F.col("embedding").isNotNull(), F.col("k1")).alias("k1"), "k2").join(every, ["k1", "k2", "label"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))

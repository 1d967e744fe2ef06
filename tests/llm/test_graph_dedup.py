import numpy as np
import pytest

from tessera.llm import graph_dedup


@pytest.mark.parametrize("cell", [60, 4000])
def test_links_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(graph_dedup, "CELL", cell)
    make = np.random.default_rng(4)
    points = make.normal(size=(700, 24))
    points = np.concatenate([points, points + make.normal(size=points.shape) * 0.3])
    units = points / np.linalg.norm(points, axis=1, keepdims=True)
    links = (units @ units.T >= 0.93).sum(1) - 1
    docs = spark.createDataFrame([(i, p, 0) for i, p in enumerate(points.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in graph_dedup.near_vectors(docs).collect()}
    assert links.sum() > 500 and [got[i] for i in range(len(points))] == links.tolist()


def test_a_walk_without_links_to_audit_is_not_trusted(monkeypatch):
    monkeypatch.setattr(graph_dedup, "search", lambda queries, points, built, cosine, same: queries @ points.T > 1 - 1e-9)
    points = np.random.default_rng(2).normal(size=(2000, 24))
    points[1000] = points[0] + 0.05
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    # Points of the audit have no copies among them: only the pair outside of it links.
    audit = np.random.default_rng(0).permutation(2000)[: graph_dedup.AUDIT]
    assert 0 not in audit and 1000 not in audit
    counts, tree = graph_dedup.link(points, np.ones(2000, np.int64), points, np.arange(2000), 0.93)
    assert counts[0] == counts[1000] == 1 and tree[0] == tree[1000]


@pytest.mark.parametrize(("centres", "each", "noise"), [(400, 2, 0.25), (5, 200, 0.27), (20, 50, 0.3)])
def test_the_walk_alone_finds_the_links_of_pairs_and_of_tight_groups(centres, each, noise):
    make = np.random.default_rng(1)
    middle = make.normal(size=(centres, 64))
    points = np.repeat(middle / np.linalg.norm(middle, axis=1, keepdims=True), each, 0) + make.normal(size=(centres * each, 64)) * noise / 8
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    true = points @ points.T >= 0.93
    found = graph_dedup.search(points, points, graph_dedup.graph(points), 0.93, np.arange(len(points)))
    assert not (found & ~true).any() and (found & true).sum() >= 0.99 * true.sum()


def expected(rows):
    """Links and least reachable ids of (vec_id, embedding, label) by all pairs."""
    def unit(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v) or not np.any(v):
            return None
        scaled = np.array(v, float) / np.abs(np.array(v, float)).max()  # squares of very large or small numbers don't fit
        return scaled / np.linalg.norm(scaled)

    units = [unit(v) for _, v, _ in rows]
    linked = [[i != j and None not in (rows[i][2], rows[j][2]) and rows[i][2] == rows[j][2] and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.93 for j in range(len(rows))] for i in range(len(rows))]
    least = [r[0] for r in rows]
    while True:
        new = [min([least[i], *(least[j] for j in range(len(rows)) if linked[i][j])]) for i in range(len(rows))]
        if new == least:
            return sorted((r[0], sum(x), c, r[0] == c) for r, x, c in zip(rows, linked, new, strict=True))
        least = new


def test_odd_vectors_repeats_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.1], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 0), (6, [0.0, 0.0], 0), (7, [-0.0, 1.0], 0), (8, [0.0, 5.0], 0), (9, [1.0, None], 0), (10, [nan, 1.0], 0), (11, [inf, 1.0], 0), (12, [], 0), (13, [1.0, 0.0, 0.0], 0), (14, [1e-300, 0.0], 0), (15, [1e300, 1e299], 0), (2, [2.0, 0.1], 0)]
    frame = spark.createDataFrame([(*r, "x", 7, 1.0) for r in rows], "vec_id long, embedding array<double>, label int, uid string, copies int, cell double")
    got = sorted(map(tuple, graph_dedup.near_vectors(frame).collect()))
    assert got == expected(rows)
    assert graph_dedup.near_vectors(frame.limit(0)).collect() == []
    nameless = spark.createDataFrame([(None, [1.0], 0), (None, [2.0], 0), (3, [1.0], 0)], "vec_id long, embedding array<double>, label int")
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in graph_dedup.near_vectors(nameless).collect()) == [("3", 2, 3, True), ("None", 2, 3, False), ("None", 2, 3, False)]


def test_planted_groups_against_all_pairs(spark):
    make = np.random.default_rng(3)
    middle = make.normal(size=(30, 16))
    points = np.concatenate([np.repeat(middle, 8, 0) + make.normal(size=(240, 16)) * 0.2, make.normal(size=(100, 16))])
    rows = [(i, p, i % 3) for i, p in enumerate(points.tolist())] + [(1000 + i, points[0].tolist(), 0) for i in range(50)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, graph_dedup.near_vectors(frame).collect())) == expected(rows)

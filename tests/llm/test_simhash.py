"""Fingerprints, links and near copies against all pairs."""

import itertools
import random

import numpy as np
import xxhash

from tessera.llm import simhash


def shingled(text, n):
    words = (text or "").encode().lower().split()
    return [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def fingerprint(text):
    found = [xxhash.xxh64_intdigest(s, 42) for s in shingled(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def smallest(ids, linked):
    """The least id that each reaches, by spreading it until nothing changes."""
    least = list(ids)
    while True:
        new = [min([least[i], *(least[j] for j in range(len(ids)) if linked(i, j))]) for i in range(len(ids))]
        if new == least:
            return least
        least = new


def near_texts(make, n):
    base = [[make.choice(["wa", "we", "Wi", "wo", "wu", "wy"]) + str(make.randrange(60)) for _ in range(make.choice([6, 40, 90]))] for _ in range(6)]
    out = ["", None, " \t", "one", "one two", "one  two"]
    while len(out) < n:
        words = list(make.choice(base))
        for _ in range(make.randrange(0, 5)):
            words[make.randrange(len(words))] = "x" + str(make.randrange(9))
        out.append(" ".join(words))
    return out


def test_fingerprints_and_links_against_all_pairs(documents):
    texts = near_texts(random.Random(1), 120) + ["word " * 60_000]
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(documents(list(enumerate(texts)), fp="x", least="y")).collect()}
    prints = [fingerprint(t) for t in texts]
    want = smallest(range(len(texts)), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    assert [rows[k]["fingerprint"] for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [rows[k]["component_id"] for k in range(len(texts))] == want


def test_shards_of_a_deep_tree_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 60)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    make = np.random.default_rng(5)
    centres = make.integers(0, 1 << 64, 40, np.uint64)
    points = np.unique(np.concatenate([centres, *(c ^ np.bitwise_or.reduce(np.uint64(1) << make.integers(0, 64, (30, k), np.uint64), axis=1) for c in centres for k in (1, 2, 3))]))
    frame = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    found = simhash.links(frame, 2, len(points)).collect()
    tree = {}

    def root(x):
        while tree.get(x, x) != x:
            x = tree[x]
        return x

    for a, b in found:
        tree[max(root(a), root(b))] = min(root(a), root(b))
    near = np.bitwise_count(points[:, None] ^ points[None]) <= 2
    signed = points.view(np.int64).tolist()
    assert all((root(signed[i]) == root(signed[j])) for i, j in np.argwhere(near).tolist())
    assert all(np.bitwise_count(np.uint64(a & (2**64 - 1)) ^ np.uint64(b & (2**64 - 1))) >= 0 for a, b in found)


def test_null_ids_repeats_and_empty_tables(documents):
    rows = simhash.near_duplicates(documents([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "other words here")])).collect()
    assert sorted(str(r["component_id"]) for r in rows) == ["5", "5", "5", "None"]
    assert simhash.near_duplicates(documents([])).collect() == [] and simhash.representatives(documents([])).collect() == []


def test_representatives_against_all_pairs(documents):
    make = random.Random(9)
    texts = near_texts(make, 80)
    shared = " ".join(f"p{i}" for i in range(30))  # a passage of many texts that are no near copies
    texts += [shared + " " + " ".join(f"q{make.randrange(10**6)}" for _ in range(make.choice([5, 9, 14]))) for _ in range(60)]
    sets = [frozenset(shingled(t, 5)) for t in texts]
    near = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 if sets[i] or sets[j] else True
    want = smallest(range(len(texts)), near)
    got = simhash.representatives(documents(list(enumerate(texts)), row_number="r"))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(want)) and "row_number" in got.columns


def test_prefixes_keep_every_similar_pair(spark):
    make = random.Random(11)
    sets = [sorted({make.randrange(12) if make.random() < 0.6 else make.randrange(60) for _ in range(make.randrange(1, 14))}) for _ in range(120)]
    points = spark.createDataFrame([(i, len(s), i) for i, s in enumerate(sets)], "uid long, n long, c long")
    frame = spark.createDataFrame([(i, bytearray(np.array(s, np.uint64).tobytes())) for i, s in enumerate(sets)], "uid long, hashes binary")
    from tessera.llm.common import Scratch

    rows = simhash.prefixes(points, frame, 0.8, Scratch(spark, "t")).collect()
    by = {}
    for r in rows:
        by.setdefault(r["key"], []).append((r["uid"], r["n"], r["rest"]))
    met = {(a, b) for own in by.values() for (a, n, x), (b, m, y) in itertools.permutations(own, 2) if min(x, y) >= 0.8 / 1.8 * (n + m) - 1e-9}
    similar = {(i, j) for i, j in itertools.permutations(range(len(sets)), 2) if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))}
    assert similar <= met


def near_sets(make, count):
    """Sets of hashes in chains of similarities of about 0.8 and more, of many sizes, and the pairs of 0.8 or more."""
    sets = []
    while len(sets) < count:
        own = {make.randrange(1 << 64) for _ in range(make.choice([4, 5, 9, 12, 30, 30, 31, 120]))}
        for _ in range(make.randrange(1, 6)):
            sets.append(np.array(sorted(own), np.uint64))
            drop = make.sample(sorted(own), make.randrange(0, 1 + len(own) // 9))
            own = own - set(drop) | {make.randrange(1 << 64) for _ in range(make.randrange(0, 1 + len(own) // 9))}
    whole = [set(s.tolist()) for s in sets]
    return sets, [(i, j) for j in range(len(sets)) for i in range(j) if len(whole[i] & whole[j]) >= 0.8 * len(whole[i] | whole[j])]


def test_candidates_of_the_stage_come_from_fingerprints_in_any_cut(spark, monkeypatch):
    from tessera.llm.common import Scratch

    sets, similar = near_sets(random.Random(4), 500)
    prints = simhash.wide_prints(np.concatenate(sets), np.array([len(s) for s in sets]))
    assert prints[:, 0].tolist() == simhash.majority(np.concatenate(sets), np.array([len(s) for s in sets])).tolist()
    assert len(similar) > 100 and all(np.bitwise_count(prints[i] ^ prints[j]).sum() <= simhash.REACH for i, j in similar)
    frame = spark.createDataFrame([(i, len(s), bytearray(p.tobytes())) for i, (s, p) in enumerate(zip(sets, prints, strict=True))], "uid long, n long, fp binary")
    for shard, lots in ((10_000, 200), (40, 6), (40, 200)):  # whole; by sizes and lots of them; in small lots
        monkeypatch.setattr(simhash, "SHARD", shard)
        monkeypatch.setattr(simhash, "LOTS", lots)
        edges = simhash.close_prints(frame, 0.8, Scratch(spark, "t")).collect()
        tree = simhash.Forest(len(sets))
        tree.add(np.array([r["a"] for r in edges]), np.array([r["b"] for r in edges]))
        assert all(tree.tree[i] == tree.tree[j] for i, j in similar) and len(np.unique(tree.tree)) > 100


def test_vantage_points_deal_tight_clusters_apart():
    make = np.random.default_rng(6)
    centres = make.integers(0, 1 << 64, (8, simhash.WIDE), np.uint64)
    flips = np.uint64(1) << make.integers(0, 64, (8, 60, simhash.WIDE), np.uint64)
    points = (centres[:, None] ^ flips).reshape(-1, simhash.WIDE)
    nodes = simhash.wide_tree(points, 20, 12)
    row, shard = simhash.wide_route(points, nodes, 12)
    assert len(nodes) >= 7 and np.bincount(shard).max() <= 60
    own = [set(shard[row == i].tolist()) for i in range(len(points))]
    near = np.bitwise_count(points[:, None] ^ points[None]).sum(2) <= 12
    assert all(own[i] & own[j] for i, j in np.argwhere(near).tolist())


def test_dense_groups_are_joined_without_listing_their_pairs():
    make = np.random.default_rng(8)
    prints = np.concatenate([np.full((3_000, simhash.WIDE), 7, np.uint64) ^ (np.uint64(1) << make.integers(0, 64, (3_000, simhash.WIDE), np.uint64)), make.integers(0, 1 << 64, (3_000, simhash.WIDE), np.uint64)])
    sizes = np.full(6_000, 50)
    tree = simhash.join_lots([(prints, sizes)], simhash.REACH, 0.8)
    assert len(set(tree[:3_000].tolist())) == 1 and len(set(tree.tolist())) == 3_001
    half = [(prints[k::2], sizes[k::2]) for k in (0, 1)]
    assert len(set(simhash.join_lots(half, simhash.REACH, 0.8).tolist())) == 3_001


def test_sets_of_a_task_are_joined_as_all_pairs_are(monkeypatch):
    make = random.Random(12)
    sets, similar = near_sets(make, 400)
    passage = [make.randrange(1 << 64) for _ in range(30)]  # of many sets that are not similar
    sets += [np.array(sorted({*passage, *(make.randrange(1 << 64) for _ in range(14))}), np.uint64) for _ in range(60)]
    make.shuffle(order := list(range(len(sets))))
    sets = [sets[k] for k in order]
    similar = [(order.index(i), order.index(j)) for i, j in similar]
    c = np.array([make.randrange(300) for _ in sets])
    for checked in (1, simhash.CHECKED):
        monkeypatch.setattr(simhash, "CHECKED", checked)
        for side in (None, np.array([make.random() < 0.5 for _ in sets])):
            want, got = simhash.Forest(300), simhash.Forest(300)
            pairs = [(c[i], c[j]) for i, j in similar if side is None or side[i] != side[j]]
            want.add(np.array([x for x, _ in pairs]), np.array([y for _, y in pairs]))
            a, b = simhash.join_sets(sets, c, side, 0.8)
            got.add(c[a], c[b])
            assert got.tree.tolist() == want.tree.tolist() and len(a) == 300 - len(set(got.tree.tolist()))


def test_lots_of_a_large_group_lose_no_link(spark, monkeypatch):
    from tessera.llm.common import Scratch

    make = random.Random(14)
    sets, similar = near_sets(make, 150)
    members = spark.createDataFrame([(7 * (i % 2), i, len(s), i // 2) for i, s in enumerate(sets)], "key long, uid long, n long, c long")
    frame = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "uid long, hashes binary")
    want, got = simhash.Forest(len(sets)), simhash.Forest(len(sets))
    same = [(i, i ^ 1) for i in range(len(sets)) if i ^ 1 < len(sets)]
    own = [(i, j) for i, j in similar if i % 2 == j % 2]
    want.add(*(np.array([p[k] for p in same + own]) for k in (0, 1)))
    monkeypatch.setattr(simhash, "LOT", 700)
    edges = [(r["a"], r["b"]) for r in simhash.exact_links(members, frame, 0.8, Scratch(spark, "t")).collect()]
    got.add(*(np.array([p[k] for p in same + edges]) for k in (0, 1)))
    assert got.tree.tolist() == want.tree.tolist() and len(own) > 20


def test_dense_groups_below_the_similarity_are_never_listed_as_pairs(documents, monkeypatch):
    make, listed = random.Random(13), []
    texts = [" ".join(f"v{k}{make.randrange(4)}" if k % 12 == 6 else f"w{k}" for k in range(150)) for _ in range(120)]  # two share some words of many texts, and rarely enough of them
    texts += [texts[5] + " end", texts[80] + " end"]
    sets = [frozenset(shingled(t, 5)) for t in texts]
    want = smallest(range(len(texts)), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9)
    verified = simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda pairs, *rest: listed.append(pairs.count()) or verified(pairs, *rest))
    got = simhash.representatives(documents(list(enumerate(texts))))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(want)) and len(set(want)) > 90
    assert listed and sum(listed) <= 3 * len(texts)

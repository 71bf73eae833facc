"""The Jaccard join against all pairs compared one by one."""

import random
import re

import numpy as np

from tallyweave.llm import jaccard_join

SCHEMA = "doc_id long, text string, n_shingles string"


def shingle_set(text, n):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows, n, percent):
    """doc_id -> (size, smallest id reachable)."""
    sets = {k: shingle_set(t, n) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    distinct = {}
    for k in sorted(sets):
        if sets[k] and (first := distinct.setdefault(sets[k], k)) != k:
            root[k] = first
    kept = sorted(distinct.items(), key=lambda x: len(x[0]))
    for i, (a, x) in enumerate(kept):
        for b, y in kept[i + 1 :]:
            if 100 * len(a) < percent * len(b):
                break
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                p, q = sorted((find(x), find(y)))
                root[q] = p
    return {k: (len(sets[k]), find(k)) for k in sets}


def spark_result(spark, rows, n, percent):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], SCHEMA)
    found = jaccard_join.jaccard_components(docs, n=n, percent=percent).collect()
    assert len(found) == len(rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}


def edited(words, rng, edits, vocabulary):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(vocabulary)
    return " ".join(out)


def test_matches_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (8, "Ünd über"), (9, "Ünd Über")]
    key = 10
    for size in (4, 12, 30, 60, 200, 900):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for edits in [0, 0, 1, 1, 2, 3] + [max(1, size // 60)] * 12 + [max(1, size // 25)] * 6:
            rows.append((key, edited(base, rng, edits, vocabulary)))
            key += 1
        rows.append((key, " ".join(base[: size - 2])))
        key += 1
    rng.shuffle(rows)
    for n, percent in ((3, 90), (5, 80)):
        assert spark_result(spark, rows, n, percent) == brute(rows, n, percent)


def test_chain_and_large_tile(spark, monkeypatch):
    """Each text links only with its neighbours; and one group of near copies larger than a block."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = random.Random(6)
    words = [f"c{i}" for i in range(400)]
    rows = [(1000 + i, " ".join(words[4 * i : 4 * i + 100])) for i in range(40)]
    base = [f"b{i}" for i in range(120)]
    vocabulary = [f"v{i}" for i in range(50)]
    rows += [(5000 + i, edited(base, rng, 2, vocabulary)) for i in range(120)]
    assert spark_result(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_empty_table_and_null_ids(spark):
    assert spark_result(spark, [], 3, 90) == {}
    docs = spark.createDataFrame([(None, "a b c d", "x"), (7, "a b c d", "x"), (None, None, "x")], SCHEMA)
    found = sorted((r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, n=3, percent=90).filter("n_shingles > 0").collect())
    assert found == [(2, 7), (2, 7)]


def test_one_document_of_each_group_stays(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, 5, 80)
    kept = jaccard_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {k for k, (n, c) in want.items() if k == c or not n}


def test_linked_sets_share_a_tile():
    """Sets cut and extended at random, short and long, whose overlap is just enough or more."""
    rng = np.random.default_rng(3)
    draw = lambda k: rng.integers(0, 2**63, k, dtype=np.uint64)
    for percent in (80, 90):
        linked = 0
        for turn in range(4000):
            size = int(np.exp(rng.uniform(0, 7.5))) if turn % 3 else int(rng.integers(1, 40))
            one = np.unique(draw(size))
            part = one[: -(-size * int(rng.integers(percent, 101)) // 100)]
            other = np.unique(np.concatenate([part, draw(int(rng.integers(0, size * (100 - percent) // 100 + 1)))]))
            both, apart = len(part), len(one) + len(other) - 2 * len(part)
            if apart and 100 * both >= percent * (both + apart):
                linked += 1
                assert set(jaccard_join.tiles(one, percent)) & set(jaccard_join.tiles(other, percent))
        assert linked > 1000


def test_linked_sets_share_a_tile_whatever_is_frequent():
    rng = np.random.default_rng(4)
    for _ in range(500):
        one = np.unique(rng.integers(0, 2**63, int(rng.integers(5, 200)), dtype=np.uint64))
        heavy = np.sort(rng.choice(one, int(rng.integers(1, len(one))), replace=False))
        place = rng.permutation(len(heavy)).astype(np.uint64) + np.uint64(1)
        other = one[len(one) // 10 :]
        if 100 * len(other) >= 90 * len(one):
            assert set(jaccard_join.tiles(one, 90, heavy, place)) & set(jaccard_join.tiles(other, 90, heavy, place))
    common = np.arange(1, 30, dtype=np.uint64)
    rare = np.arange(1000, 1010, dtype=np.uint64)
    assert set(jaccard_join.tiles(np.concatenate([common, rare]), 80, common, common)) <= set(rare.astype(np.int64))


def test_frequent_elements_are_found_and_change_nothing(spark, monkeypatch):
    """A line that all texts share, beside near copies; with and without knowing what is frequent."""
    rng = random.Random(8)
    line = " ".join(f"l{i}" for i in range(40))
    rows = []
    for i in range(40):
        base = [f"d{i}w{k}" for k in range(60)]
        rows += [(3 * i + j, f"{line} {edited(base, rng, j, ['x', 'y'])}") for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    heavy, place = jaccard_join.heavy_elements(docs.coalesce(1), 5)
    assert set(jaccard_join.shingles(line, 5)) <= set(heavy) and sorted(place) == list(range(1, len(heavy) + 1))
    want = brute(rows, 5, 80)
    assert spark_result(spark, rows, 5, 80) == want
    monkeypatch.setattr(jaccard_join, "MAX_HEAVY", 3)
    assert spark_result(spark, rows, 5, 80) == want


def test_both_kinds_of_tiles_give_the_same(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for size in (6, 25, 70, 130, 260):
        base = [rng.choice(vocabulary) for _ in range(size)]
        rows += [(len(rows) + i, edited(base, rng, i // 3, vocabulary)) for i in range(12)]
    want = brute(rows, 3, 90)
    for start in (0, 101):
        monkeypatch.setattr(jaccard_join, "SEGMENTS_FROM", start)
        assert spark_result(spark, rows, 3, 90) == want


def test_sets_that_share_a_node_are_told_apart(spark, monkeypatch):
    """With one hash bit left in the node, all sets of one size share two nodes."""
    monkeypatch.setattr(jaccard_join, "SIZE_BITS", 62)
    rows = [(4 * i + j, " ".join([f"d{i}w{k}" for k in range(60)] + [f"z{k}" for k in range(j)])) for i in range(12) for j in range(4)]
    assert spark_result(spark, rows, 3, 90) == brute(rows, 3, 90)

import random

import numpy as np
import pytest
from brute import near_components

from loomtext.llm import jaccard_join
from loomtext.llm.common import Scratch


def run(spark, docs, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted((tuple(r) for r in jaccard_join.components(d, **more).collect()), key=str)


def test_cases(spark):
    base = [f"w{i}" for i in range(100)]
    edited = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(base))
    docs = [
        (9, " ".join(base)), (3, edited(50)), (4, edited(50, 99).upper()), (5, edited(1, 50, 99)), (6, edited(20, 40, 60, 80)), (7, None), (8, ""),
        (10, "  "), (11, "one"), (2, "ONE"), (12, "one two"), (13, "a b c"), (14, "a  b\tc"), (15, " ".join(base + base)), (1, "zz " * 40), (16, "zz " * 30),
    ]
    assert run(spark, docs) == sorted(near_components(docs), key=str)
    assert run(spark, docs, n=5, percent=80) == sorted(near_components(docs, 5, 80), key=str)


@pytest.mark.parametrize("percent", [60, 90])
def test_random(spark, percent):
    rng = random.Random(percent)
    bases = [[f"v{rng.randrange(400)}" for _ in range(rng.randrange(5, 80))] for _ in range(5)]
    passage = [f"p{i}" for i in range(15)]
    docs = []
    for i in range(150):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(99)}"
        docs.append((1000 - i, " ".join(w + passage * (i % 3 == 0))))
    assert run(spark, docs, percent=percent) == sorted(near_components(docs, 3, percent), key=str)


def test_tree_against_all_pairs():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 25)).astype(np.uint64)) for _ in range(300)]
    sets = list({s.tobytes(): s for s in sets}.values())
    tree = jaccard_join.PrefixTree(sets)
    for probe in sets[:60]:
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= 70 * len(np.union1d(s, probe))]
        assert sorted(tree.walk(probe, 70)) == want


def test_forest_against_all_pairs():
    rng = np.random.default_rng(5)
    for percent in (60, 80):
        sets = [np.unique(rng.integers(0, 25, rng.integers(0, 20)).astype(np.uint64)) for _ in range(200)]
        labels, sizes = rng.integers(0, 120, 200), np.array([len(s) + 1 for s in sets])
        alike = lambda i, j: 100 * (len(np.intersect1d(sets[i], sets[j])) + 1) >= percent * len(np.union1d(sets[i], sets[j])) + percent  # noqa: E731, B023
        for tree, probes in ((np.arange(200), np.arange(200)), (np.arange(90), np.arange(90, 200))):
            links = jaccard_join.Forest(sets, sizes, labels, tree, probes, percent).grown()
            assert all(labels[i] != labels[j] and alike(i, j) for i, j in links) and len(links) < 120

            def parts(edges):
                top = list(range(200))

                def find(x):
                    while top[x] != x:
                        x = top[x]
                    return x

                for i, j in edges:
                    top[find(i)] = find(j)
                return {frozenset(i for i in range(200) if find(i) == r) for r in {find(i) for i in range(200)}}

            first = [(int(np.flatnonzero(labels == v)[0]), int(i)) for i, v in enumerate(labels)]
            every = [(i, j) for i in tree.tolist() for j in probes.tolist() if i != j and alike(i, j)]
            assert parts(first + links) == parts(first + every)


def test_common_gram_of_a_thousand_variants(spark, monkeypatch):
    """Variants of one short text that share most n-grams; nearly none are links, some are chains."""
    monkeypatch.setattr(jaccard_join, "GROUP", 150)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(900):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 2, 3, 3])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(3)}"
        docs.append((i, " ".join(w[: rng.randrange(40, 61)])))
    for percent in (80, 90):
        assert run(spark, docs, percent=percent) == sorted(near_components(docs, 3, percent), key=str)


def test_chain(spark):
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"zz", b"zy")], "a binary, b binary")
    got = {bytes(r[0]): bytes(r[1]) for r in jaccard_join.connected(edges, Scratch(spark), "t").collect()}
    assert got == {bytes([i]): b"\x00" for i in range(41)} | {b"zz": b"zy", b"zy": b"zy"}


def test_nulls_ties_empty(spark):
    rows = [(None, "a b c d", 1), (5, "a b c d", 2), (5, "a b c d", 2), (None, None, None), (6, None, 3), (None, "lone text here", 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, sig int")
    got = sorted((tuple(r) for r in jaccard_join.components(d).collect()), key=str)
    assert got == sorted([(None, 2, 5), (5, 2, 5), (5, 2, 5), (None, 0, None), (6, 0, 6), (None, 1, None)], key=str)
    kept = jaccard_join.keep_first(d)
    assert kept.columns == d.columns and kept.where("doc_id = 5").count() == 1
    assert jaccard_join.components(d.limit(0)).count() == 0


def test_table(spark):
    at = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in jaccard_join.op1(spark, at).collect()) == near_components(docs)

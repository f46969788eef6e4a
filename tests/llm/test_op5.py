import random

import numpy as np
import pyarrow as pa
from brute import without_repeats
from pyspark.sql import functions as F

from loomtext.llm import substring_dedup
from loomtext.llm.text import word_runs


def run(spark, docs):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = substring_dedup.remove_repeats(d)
    words = F.concat_ws(" ", F.expr(r"filter(split(coalesce(kept_text, ''), '[\\x20\\x09-\\x0D]+'), x -> x != '')"))
    rows = found.select("row.doc_id", "n_words", "n_removed", F.sha2(words, 256)).collect()
    return sorted(map(tuple, rows), key=str)


def expected(docs):
    return sorted(((d, *v) for d, v in without_repeats(docs).items()), key=str)


def test_cases(spark):
    base = [f"w{i}" for i in range(40)]
    docs = [
        (1, " ".join(base)), (2, " ".join(base)), (3, "x\ty " + "\n ".join(base[5:18]) + " z"), (4, " ".join(base[5:17])), (5, None), (6, ""),
        (7, " \n"), (8, "a " * 50), (9, "a " * 13), (10, "a " * 12), (11, "b a " + "a " * 20 + "c"), (12, " ".join(base[20:] + base[:20])),
        (13, " ".join(base + base)), (14, "É ü " + " ".join(base[:13]).upper()), (0, " ".join(["q"] + base[3:30])), (-5, " ".join(base[25:])),
    ]
    assert run(spark, docs) == expected(docs)


def test_random(spark):
    rng = random.Random(5)
    for size in (1, 2, 3, 30):
        pool = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[:size]) for _ in range(rng.randrange(60))) for _ in range(12)]
        docs = [(i, f"{rng.choice(pool)} {rng.choice(pool)[rng.randrange(9):]} u{rng.randrange(3)} {rng.choice(pool)}") for i in rng.sample(range(-99, 99), 40)]
        assert run(spark, docs) == expected(docs)


def high(words):
    run = next(word_runs(pa.array([" ".join(words)])))
    at, span = substring_dedup.high_symbols(run.hashes(), run.doc_of())
    assert (span >= substring_dedup.HIGH).all() and (at[1:] >= (at + span)[:-1]).all()
    return {tuple(words[a : a + n]): a for a, n in zip(at.tolist(), span.tolist())}


def test_high_symbols_of_equal_passages():
    """Interior symbols of a passage are the same in any context, runs are one symbol, and nearly all text is in some."""
    rng = random.Random(6)
    some = lambda n, letters: ["".join(rng.choice(letters) for _ in range(4)) for _ in range(n)]
    passage = some(150, "abcd") + ["z"] * 40 + some(150, "abcd")
    one, two = high(some(200, "efgh") + passage + some(80, "efgh")), high(some(33, "ijkl") + passage)
    both = [w for w in one if w in two]
    assert sum(map(len, both)) >= 0.6 * len(passage)
    assert any("z" in w for w in both)
    assert sum(map(len, one)) >= 0.7 * 620
    assert not any(set(w) <= set(some(9, "mnop")) for w in one)


def test_repeats_are_revealed_by_high_symbols():
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))
    block = substring_dedup.Block(pa.table({"doc_id": [2, 1], "text": [text, "x y " + text]}))
    shared, none = np.ones(len(block.keys), bool), np.zeros(len(block.highs.least), bool)
    repeats = block.repeats(none)
    found, _ = block.windows(shared, repeats)
    every, _ = block.windows(shared, [(at[:0], size[:0]) for at, size in repeats])
    assert sum(size.sum() for _, size in repeats) > 200 and len(found.ids) < 0.8 * len(every.ids)
    assert all((p.id_of(at) == 2).all() for p, (at, _) in zip(block.parts, repeats))


def test_long_copies(spark):
    rng = random.Random(9)
    pool = [[f"w{rng.randrange(3000)}" for _ in range(700)] for _ in range(3)] + [["r"] * 90 + [f"v{k}" for k in range(80)] + ["s", "t"] * 60]
    docs = []
    for i in range(40):
        own = rng.choice(pool)
        a = rng.randrange(len(own) - 30)
        docs.append((rng.randrange(10**6) * 50 + i, " ".join(own[a : a + rng.randrange(20, 600)] + [f"u{i}"] + rng.choice(pool)[:200])))
    assert run(spark, docs) == expected(docs)


def test_ties_nulls_and_extra_columns(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text, 7, "k"), (1, text, 8, None), (None, text, None, None), (None, None, None, None), (0, "short one", 1, "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, blk int, kept_text string")
    got = substring_dedup.remove_repeats(d).select("row.*", "n_removed", F.col("kept_text").alias("t")).collect()
    assert sorted(((r["doc_id"], r["blk"], r["n_removed"], r["t"]) for r in got), key=str) == sorted(
        [(1, 7, 0, text), (1, 8, 0, text), (None, None, 20, ""), (None, None, 0, None), (0, 1, 0, "short one")], key=str
    )
    assert substring_dedup.remove_repeats(d.limit(0)).count() == 0


def test_table(spark):
    at = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, substring_dedup.op5(spark, at).collect()), key=str)
    assert got == expected(docs)

import random
from collections import Counter

from pyspark.sql import functions as F

from loomtext.llm import blocks, jaccard_join, lm, substring_dedup

WORDS = [f"w{i}" for i in range(3000)]


def without_ids(spark):
    """A third of the rows has no id; many of them share passages with others."""
    rng = random.Random(3)
    pool = [" ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(6)]
    docs = [(None if k % 3 == 0 else k, " ".join([rng.choice(pool), *rng.choices(WORDS, k=20), rng.choice(pool)])) for k in range(300)]
    return docs, spark.createDataFrame(docs, "doc_id long, text string")


def test_rows_without_ids_are_spread(spark):
    docs, d = without_ids(spark)
    own = blocks.dealt(d).where("doc_id is null").groupBy("blk").count().collect()
    assert len(own) > blocks.PER_PARTITION and max(r["count"] for r in own) < 30
    rows = blocks.dealt_rows(d).select("row.*", "blk").collect()
    assert sorted(map(str, rows)) == sorted(map(str, blocks.dealt(d).collect()))


def test_repeats_in_rows_without_ids(spark):
    docs, d = without_ids(spark)
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, text in docs:
        w = text.split()
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, float("inf")), order(i))
    expected = Counter()
    for i, text in docs:
        w = text.split()
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < order(i) for j in range(k, k + 13)}
        expected[i, text, len(gone)] += 1
    rows = substring_dedup.remove_repeats(d).select("row.doc_id", "row.text", "n_removed").collect()
    assert Counter(map(tuple, rows)) == expected


def test_scores_and_components_need_no_ids(spark):
    docs, d = without_ids(spark)
    named = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(docs)], "doc_id long, text string")
    learned = F.length("text") % 5 == 1
    scores = [lm.score_texts(x, learned).select("row.text", F.round("score", 9), "n_known").collect() for x in (d, named)]
    assert Counter(map(tuple, scores[0])) == Counter(map(tuple, scores[1]))
    twin = [(None, " ".join(WORDS[:90])), (8, " ".join(WORDS[1:90])), (None, " ".join(WORDS[:89])), (None, "alone here")]
    got = jaccard_join.components(spark.createDataFrame(twin, "doc_id long, text string")).collect()
    assert Counter(r["component_id"] for r in got) == {8: 3, None: 1}

import time

import corpus_pipeline
import pytest
from brute import near_components, without_repeats
from odd import odd_rows, plain
from test_op2 import brute_mix
from test_op8 import brute as brute_windows

from loomtext.llm import quality

AT = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, tmp_path):
    began = time.time()
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    first = docs
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, AT)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r["doc_id"]: r for r in docs.collect()})
    good = {r[0] for r in quality.op9(spark, AT).where("kept").select("doc_id").collect()}
    assert kept[0].keys() == good
    groups = near_components([(d, r["text"]) for d, r in kept[0].items()], 5, 80)
    assert kept[1].keys() == {d for d, _, c in groups if d == c}
    repeats = without_repeats([(d, r["text"]) for d, r in kept[1].items()])
    assert kept[2].keys() == {d for d, (n, gone, _) in repeats.items() if not gone or gone < n}
    assert all(len(r["text"].split()) == repeats[d][0] - repeats[d][1] and r["n_chars"] == len(r["text"]) for d, r in kept[2].items())
    items = [tuple(r) for r in spark.read.parquet(f"{AT}/benchmark.parquet").select("item_id", "text").collect()]
    found = brute_windows([(d, r["text"]) for d, r in kept[2].items()], items)
    assert kept[3].keys() == {d for d, x in found.items() if not x[-1]}
    mix = brute_mix([(d, r["source"], r["size"]) for d, r in kept[4].items()], 1.0)
    assert {d: r["taken"] for d, r in kept[4].items()} == mix and kept[4].keys() == kept[3].keys()
    rows = sorted(map(tuple, corpus_pipeline.run(spark, AT).collect()), key=str)
    assert rows == sorted(map(tuple, docs.collect()), key=str)
    assert first.count() > len(rows) > 0
    assert time.time() - began < 240


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows(spark, stage):
    """Nulls, empties, ties, repeated rows, a long text and clashing names: nothing crashes, columns stay."""
    d = odd_rows(spark)
    out = corpus_pipeline.STAGES[stage][1](spark, d, AT)
    rows = out.collect()
    if stage < 4:
        assert out.columns == d.columns
        have = {plain(r) for r in d.collect()}
        assert all(plain(r) in have for r in rows if stage != 2)
    else:
        assert len(rows) == d.count() and out.columns[-4:] == ["size", "source_size", "target", "taken"]
        assert {"input_size", "input_target", "input_taken"} <= set(out.columns)
    texts = [r["text"] for r in rows]
    if stage == 0:
        assert None not in texts and "" not in texts
    elif stage == 1:
        assert sum(t is None for t in texts) == 3 and texts.count("") == 1
    elif stage in (2, 3):
        assert sum(t is None for t in texts) == 3
    empty = corpus_pipeline.STAGES[stage][1](spark, d.limit(0), AT)
    assert empty.columns == out.columns and empty.count() == 0

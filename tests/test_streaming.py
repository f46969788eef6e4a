import pytest
from pyspark.sql import functions as F

from loomtext.operators import consensus, measurements
from loomtext.streaming import consensus as running

TEXTS = ["a cat sat on the mat", "the dog ran", "a cat sat", "", "on the mat a dog", "the dog ran off on the mat", "a", "cat cat cat"]


def samples(spark):
    rows = [(k, TEXTS[-k], [TEXTS[k], TEXTS[(k * 3) % len(TEXTS)]]) for k in range(len(TEXTS))]
    return spark.createDataFrame([*rows, (99, None, ["a dog", None])], "id long, hyp string, refs array<string>")


def whole(spark):
    s = samples(spark).withColumn("hyp", F.coalesce("hyp", F.lit("")))
    refs = s.select("id", F.posexplode("refs").alias("ref_idx", "text")).withColumn("text", F.coalesce("text", F.lit("")))
    return {r["id"]: round(r["cider_d"], 9) for r in consensus.sentence_scores(s.select("id", F.col("hyp").alias("text")), refs).collect()}


@pytest.mark.parametrize("files", [1, 3, 9])
def test_any_split_gives_the_same_scores(spark, tmp_path, files):
    state = running.RunningConsensus(spark, str(tmp_path / "state"))
    running.done(state.attach(running.in_batches(spark, samples(spark), str(tmp_path / "in"), files), availableNow=True))
    assert {r["id"]: round(r["cider_d"], 9) for r in state.scores().collect()} == whole(spark)


def test_batches_run_again_and_sessions_go_on(spark, tmp_path):
    one = running.RunningConsensus(spark, str(tmp_path))
    first, rest = samples(spark).where("id < 3"), samples(spark).where("id >= 3")
    one.update(first, 0)
    one.update(samples(spark).where("id > 5"), 1)  # a batch that failed after it had written something else
    again = running.RunningConsensus(spark, str(tmp_path))
    again.update(rest, 1)
    again.update(first, 0)
    found = again.compute(tfidf=True)
    assert {r["id"]: round(r["cider_d"], 9) for r in found["sentences"].collect()} == whole(spark)
    assert round(found["corpus"].first()[0], 9) == round(sum(whole(spark).values()) / 9, 9)
    bags = {(r["id"], r["ref_idx"], r["n"]): r["tfidf"] for r in found["references"].collect()}
    assert set(bags[1, 0, 2]) == {"the dog", "dog ran"} and len({r["id"] for r in found["candidates"].collect()}) == 7


def test_too_few_samples(spark, tmp_path):
    state = running.RunningConsensus(spark, str(tmp_path))
    state.update(samples(spark).where("id = 1"), 0)
    with pytest.raises(ValueError, match="two samples"):
        state.scores()


def test_frequencies_that_are_a_function(spark):
    s = samples(spark).where("id < 8")
    cand, refs = s.select("id", F.col("hyp").alias("text")), s.select("id", F.posexplode("refs").alias("ref_idx", "text"))
    known = consensus.document_frequencies(refs)
    table = {tuple(r["gram"]): r["df"] for r in known.collect()}
    asked = F.create_map(*[x for g, n in table.items() for x in (F.lit(" ".join(g)), F.lit(n))])
    scores = lambda df: sorted((r["id"], round(r["cider_d"], 9)) for r in consensus.sentence_scores(cand, refs, df=df).collect())
    assert scores(lambda gram: F.try_element_at(asked, F.array_join(gram, " "))) == scores(known) == scores(None)


def test_observed_runs(spark):
    runs = [spark.range(k).toDF("x") for k in range(4)]
    got = measurements.observed(runs, {"rows": F.count(F.lit(1)), "top": F.max("x")}, warmup=1)
    assert [(r["it"], r["rows"], r["top"]) for r in got.orderBy("it").collect()] == [(1, 1, 0), (2, 2, 1), (3, 3, 2)]
    assert got.where("seconds <= 0").count() == 0
    with pytest.raises(ValueError, match="nothing"):
        measurements.observed([], {})
    means = spark.createDataFrame([(1.5, 0.25, 0.2, 0.05)], "memory_gb double, inference_s double, ttft_s double, tpot_s double")
    assert measurements.shown(means)[0] == "Average memory used during inference: 1.5000 GB" and measurements.shown(means)[3] == "Average TPOT: 0.0500 seconds"
    assert consensus.shown(12.5) == "SPIDEr: 12.5"


def test_own_frequencies_are_not_counted_for_the_check(spark, monkeypatch):
    looked, real = [], consensus.checked
    monkeypatch.setattr(consensus, "checked", lambda n, df: (looked.append(df), real(n, df)))
    s = samples(spark).where("id < 8")
    cand, refs = s.select("id", F.col("hyp").alias("text")), s.select("id", F.posexplode("refs").alias("ref_idx", "text"))
    consensus.sentence_scores(cand, refs)
    assert "Aggregate" not in looked[0]._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError, match="no words"):
        consensus.sentence_scores(cand, refs.withColumn("text", F.lit(" ")))


def test_a_batch_is_not_one_file_and_grams_travel_once(spark, tmp_path):
    state = running.RunningConsensus(spark, str(tmp_path / "state"))
    running.done(state.attach(running.in_batches(spark, samples(spark), str(tmp_path / "in"), 1), availableNow=True))
    assert len(list((tmp_path / "in").glob("part-*.parquet"))) > 1
    plan = state.scores()._jdf.queryExecution().executedPlan().toString()
    assert 1 <= sum("Exchange hashpartitioning" in line and "gram" in line for line in plan.splitlines()) <= 4


def test_many_references_and_tokens_with_blanks(spark, tmp_path, monkeypatch):
    """A sample that is dealt to several tasks; grams whose tokens are the same only when put together."""
    monkeypatch.setattr(consensus, "TOGETHER", 2)
    commas = lambda text: F.split(text, ",")
    texts = ["a b,c,d", "a,b c,d", "a b,c", "a\\,_b,c", "a\\_,b,c", "a_b,c d", "d,a b,c"]
    rows = [(k, texts[k % 7], [texts[(k + j) % 7] for j in range(k)]) for k in range(9)]
    s = spark.createDataFrame(rows, "id long, hyp string, refs array<string>")
    state = running.RunningConsensus(spark, str(tmp_path), tokenize=commas)
    state.update(s.where("id < 5"), 0)
    state.update(s.where("id >= 5"), 1)
    s = s.where("id > 0")
    refs = s.select("id", F.posexplode("refs").alias("ref_idx", "text"))
    plain = consensus.sentence_scores(s.select("id", F.col("hyp").alias("text")), refs, tokenize=commas)
    shown = lambda df: sorted((r["id"], round(r["cider_d"], 9)) for r in df.collect())
    assert shown(state.scores()) == shown(plain) and len(shown(plain)) == 8

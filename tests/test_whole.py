import __spark_entry__ as contract


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_whole_turns(spark, tmp_path):
    user = " ".join(f"Word{k % 70}" for k in range(200))
    reply = " ".join(f"Word{k % 70}" if k % 9 else "other" for k in range(190))
    rows = [(1, 0, "user", user), (1, 1, "assistant", reply), (1, 2, "user", "short"), (1, 3, "assistant", "short")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    queries = contract.queries()
    got = {r["turn"]: r["tokenized"] for r in queries["tokenize_chars"](spark, str(tmp_path)).collect()}
    assert got == {t: " ".join(x.replace(" ", "▁")).lower() for _, t, _, x in rows}
    got = {r["turn"]: (r["distance"], r["ref_length"]) for r in queries["wer_raw_conversations"](spark, str(tmp_path)).collect()}
    assert got == {0: (distance(user.split(), reply.split()), 200), 2: (0, 1)}


def test_rows_with_numbers(spark, tmp_path):
    turns = [(1, 0, "user", "Two hundred and five"), (1, 1, "assistant", "the cat sat"), (1, 2, "user", "20 million dollars")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    items = [(1, "two hundred and five"), (2, "205"), (3, "the cat sat"), (4, "the cat sit")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    queries = contract.queries()
    run = lambda name: [tuple(r) for r in queries[name](spark, str(tmp_path)).collect()]
    assert sorted(run("normalize_text")) == [(1, 0, "205"), (1, 1, "the cat sat"), (1, 2, "$20000000")]
    assert sorted(run("wer_by_pair")) == [(1, 0, 1), (2, 3, 1), (3, 1, 3)]
    assert run("wer_corpus") == [(4, 5, 0.8)]


def test_each_step_stands_once_in_the_plan(spark):
    queries = contract.queries()
    for name, most in (("normalize_text", 90), ("wer_corpus", 180)):
        plan = queries[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert 40 < plan.count("regexp_replace(") <= most, (name, plan.count("regexp_replace("))


def test_normalized_like_the_single_expression(spark):
    from pyspark.sql import functions as F

    from loomtext.functions import normalize

    d = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("text").unionAll(spark.createDataFrame([(None,), ("Mr. Smith's twenty-one œuvres",)], "text string"))
    out = normalize.with_normalized(d, "text", "a").withColumn("b", normalize.normalized(F.col("text")))
    assert out.where("not (a <=> b)").count() == 0


def test_long_pairs(spark):
    """Tables of bits against tables of cells, and 20,000 tokens against 18,000 within seconds."""
    import random
    import time

    from pyspark.sql import functions as F

    from loomtext.operators.edit_distance import by_bits, token_distance

    rng = random.Random(1)
    some = lambda n, v: [str(rng.randrange(v)) for _ in range(rng.randrange(n))]
    for _ in range(500):
        v = rng.choice([2, 4, 30])
        a, b = some(40, v), some(40, v)
        assert by_bits(a, b) == distance(a, b), (a, b)
    pairs = [(some(900, 50), some(900, 50)) for _ in range(30)] + [([], []), (["x"] * 700, []), (None, ["x"])]
    d = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a array<string>, b array<string>")
    got = [r["d"] for r in d.select("k", token_distance(F.col("a"), F.col("b")).alias("d")).orderBy("k").collect()]
    assert got == [None if a is None else distance(a, b) for a, b in pairs]
    a = [str(rng.randrange(3000)) for _ in range(20_000)]
    b = [x if rng.random() < 0.7 else str(rng.randrange(3000)) for x in a if rng.random() < 0.9]
    began = time.time()
    assert 5000 < by_bits(a, b) < 9000 and time.time() - began < 10

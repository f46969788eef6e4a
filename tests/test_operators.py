import random

import pytest
from pyspark.sql import functions as F

from loomtext.functions import tokens
from loomtext.operators import batching, consensus, edit_distance, measurements, word_errors
from loomtext.sources import annotations, submission
from loomtext.streaming import word_errors as streamed


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distances_agree(spark):
    rng = random.Random(1)
    make = lambda n: [f"t{rng.randrange(12)}" for _ in range(rng.randrange(n))]
    rows = [(make(20), make(20)) for _ in range(40)] + [(make(900), make(900)) for _ in range(6)] + [([], []), ([], ["a"]), (None, ["a"])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<string>, b array<string>").select(edit_distance.token_distance(F.col("a"), F.col("b"))).collect()]
    assert got == [None if a is None else distance(a, b) for a, b in rows]


def test_corpus_rate(spark):
    pairs = spark.createDataFrame([("the cat sat", "the cat sit"), ("hello world", "hello")], "ref string, hyp string")
    assert word_errors.word_error_rate(pairs) == pytest.approx(0.4)
    assert word_errors.shown(0.4) == "WER: 40.0000%"
    nothing = word_errors.pair_errors(spark.createDataFrame([("", "x")], "ref string, hyp string"))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        word_errors.corpus_rate(nothing).collect()
    assert word_errors.corpus_rate(nothing, lenient=True).first()["wer"] is None
    hyps, refs = spark.createDataFrame([(1, "a")], "k int, hyp string"), spark.createDataFrame([(1, "a"), (2, "b")], "k int, ref string")
    with pytest.raises(Exception, match="no hypothesis"):
        word_errors.paired(hyps, refs, "k").collect()


CIDER = [
    ([("a b c d e", ["a b c d e"]), ("f g h i j", ["f g h i j"])], [10, 10]),
    ([("a b c d", ["a b c d e"]), ("f g h i j", ["f g h i j"])], [8.096898, 10]),
    ([("a b c", ["a b c"]), ("f g h", ["f g h"])], [7.5, 7.5]),
    ([("a b c d", ["a b c d"]), ("a b c d", ["a b c d"])], [0, 0]),
    ([("a b c d", ["a b c d", "x y z w"]), ("f g h i", ["f g h i"])], [5, 10]),
]


@pytest.mark.parametrize(("samples", "want"), CIDER)
def test_cider(spark, samples, want):
    cand = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(samples)], "id int, text string")
    refs = spark.createDataFrame([(k, i, r) for k, (_, rs) in enumerate(samples) for i, r in enumerate(rs)], "id int, ref_idx int, text string")
    got = {r["id"]: r["cider_d"] for r in consensus.sentence_scores(cand, refs).collect()}
    assert [got[k] for k in range(len(want))] == pytest.approx(want, abs=1e-6)


def test_cider_errors(spark):
    one = spark.createDataFrame([(1, "a b", "a b")], "id int, hyp string, ref string")
    with pytest.raises(ValueError, match="two samples"):
        consensus.sentence_scores(*consensus.single(one))
    empty = spark.createDataFrame([(1, "a", ""), (2, "b", " ")], "id int, hyp string, ref string")
    with pytest.raises(ValueError, match="no words"):
        consensus.sentence_scores(*consensus.single(empty))
    both = spark.createDataFrame([(1, "a b c d e", "a b c d e"), (2, "f g h i j", "f g h i j")], "id int, hyp string, ref string")
    assert consensus.spider(both).first()["spider"] == 1000.0


FILES = [
    ("testset_id,text\ntest0000,hello\n", submission.PASSED), ("testset_id,text\n", submission.PASSED), ("text,testset_id\nhello,test0000\n", submission.BAD_COLUMNS),
    ("testset_id,text,x\ntest0000,a,b\n", submission.BAD_COLUMNS), ("testset_id,text\ntest000,hello\n", submission.BAD_IDS), ("testset_id,text\ntest0000,\n", submission.BAD_TEXT),
    ("testset_id,text\ntest0000,NA\n", submission.BAD_TEXT), ("testset_id,text\ntest0000,12\n", submission.BAD_TEXT), ("testset_id,text\ntest0000,12\ntest0001,abc\n", submission.PASSED),
    ("testset_id,text\ntest0000,a,b\n", submission.BAD_IDS), ("", submission.EMPTY),
]


@pytest.mark.parametrize(("body", "want"), FILES)
def test_submission(spark, tmp_path, body, want):
    (tmp_path / "s.csv").write_text(body)
    assert submission.validate(spark, f"{tmp_path}/s.csv") == want


def test_submission_missing_and_written(spark, tmp_path):
    assert submission.validate(spark, f"{tmp_path}/none.csv") == submission.NOT_FOUND
    d = spark.createDataFrame([("test0001", "a, b"), ("test0002", "c")], "testset_id string, text string")
    submission.write(d, f"{tmp_path}/out")
    assert submission.validate(spark, f"{tmp_path}/out") == submission.PASSED


def test_annotations(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"annotation": [{"testset_id": "x", "path": "p.wav", "text": "hi"}, {"testset_id": "y", "path": "q.wav", "task": "aac", "Q": "?"}]}')
    items = annotations.read_annotations(spark, f"{tmp_path}/a.json", "root")
    assert [tuple(r) for r in items.select("position", "path", "task", "text", "Q").orderBy("position").collect()] == [(0, "root/p.wav", "asr", "hi", ""), (1, "root/q.wav", "aac", None, "?")]
    assert "text" not in annotations.read_annotations(spark, f"{tmp_path}/a.json", with_text=False).columns
    assert annotations.sample_at(items, 1).first()["testset_id"] == "y"
    audio = spark.createDataFrame([("root/p.wav", [1.0, 2.0])], "path string, samples array<double>")
    assert [r["samples"] for r in annotations.with_audio(items, audio).collect()] == [[1.0, 2.0]] * 2
    with pytest.raises(Exception, match="no prompt"):
        annotations.prompted(items, spark.createDataFrame([("asr", "go")], "task string, prompt string")).collect()
    (tmp_path / "m.json").write_text('{"colour": "color"}')
    assert [tuple(r) for r in annotations.read_lookup(spark, f"{tmp_path}/m.json").collect()] == [(0, "colour", "color")]
    d = spark.createDataFrame([("Hello<|end_of_text|>junk<|end_of_text|>",), ("No End",), ("<|end_of_text|>x",)], "t string")
    assert [r[0] for r in d.select(annotations.hypothesis(F.col("t"))).collect()] == ["hello", "no end", ""]
    mock = annotations.mock_samples(spark, 10, 2, 5)
    assert mock.count() == 5 and mock.select("raw_wav").distinct().count() == 1


def test_measurements(spark):
    runs = spark.createDataFrame([(0, 0, 9.0, 9.0), (1, 0, 9.0, 9.0), (2, 1 << 30, 1.0, 0.1), (3, 1 << 30, 2.0, 0.2), (4, 1 << 30, 3.0, 0.3)], "it int, memory long, ttft double, tpot double")
    assert list(measurements.summary(runs, 2).first()) == pytest.approx([1.0, 2.2, 2.0, 0.2])
    assert [r["memory"] for r in measurements.running_peak(runs).orderBy("it").collect()] == [0, 0, 1 << 30, 1 << 30, 1 << 30]


def test_batches(spark):
    d = spark.createDataFrame([(k, [1.0] * (k % 4)) for k in range(21)], "k int, v array<double>").repartition(5)
    out = {r["k"]: r for r in batching.padded(batching.in_batches(d, "k", 8), "v").collect()}
    assert [out[k]["batch_id"] for k in range(21)] == [k // 8 for k in range(21)]
    assert out[5]["v"] == [1.0, 0.0, 0.0] and out[5]["padding_mask"] == [False, True, True]
    one = spark.createDataFrame([([[1.0, 5.0], [2.0, 6.0]],)], "w array<array<double>>")
    assert one.select(batching.prepared(batching.first_channel(F.col("w")), 4, 3, 1)).first()[0] == [1.0, 2.0, 0.0]


def test_streamed_rate(spark, tmp_path):
    pairs = spark.createDataFrame([("the cat sat", "the cat sit"), ("hello world", "hello")], "ref string, hyp string")
    pairs.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ref string, hyp string").parquet(f"{tmp_path}/in")
    query = streamed.running_rate(stream, tokenize=tokens.words).writeStream.outputMode("complete").format("memory").queryName("rate").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("rate").first()["wer"] == pytest.approx(0.4)


def test_submission_file_with_line_ends_and_quotes(spark, tmp_path):
    rows = spark.createDataFrame([("test0000", 'said "so",\ntwice'), ("test0001", "b\\"), ("test0002", "c")], "testset_id string, text string")
    for files in (1, None):
        submission.write(rows, f"{tmp_path}/f{files}", files)
        assert submission.validate(spark, f"{tmp_path}/f{files}") == submission.PASSED
    (tmp_path / "quoted.csv").write_text('testset_id,text\ntest0000,"a ""b"",\ntest9"\ntest0001,c\n')
    assert submission.validate(spark, str(tmp_path / "quoted.csv")) == submission.PASSED


def test_scores_of_tasks(spark):
    from loomtext.operators import scoring

    rows = [(1, "asr", "the cat", "The cat sat."), (2, "other", "x", "y"), (3, None, "x", "y")]
    samples = spark.createDataFrame(rows, "id int, task string, hyp string, ref string")
    assert [(r["task"], r["metric"], round(r["score"], 4)) for r in scoring.task_scores(samples).collect()] == [("asr", "WER", 0.3333)]
    assert scoring.task_scores(samples, skip=True).count() == 0
    assert scoring.task_scores(samples.limit(0)).count() == 0


def test_document_frequencies_beyond_the_samples(spark):
    cand = spark.createDataFrame([(1, "a b"), (2, "c d")], "id int, text string")
    refs = spark.createDataFrame([(1, 0, "a b"), (2, 0, "c e")], "id int, ref_idx int, text string")
    df = spark.createDataFrame([(["a"], 3)], "gram array<string>, df int")
    with pytest.raises(ValueError, match="more documents"):
        consensus.sentence_scores(cand, refs, df=df)

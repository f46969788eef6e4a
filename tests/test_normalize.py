import random

import pytest
from pyspark.sql import functions as F
from spoken import standardize

from loomtext.functions import normalize, numbers, tokens
from loomtext.sources import annotations

NUMBERS = [
    ("one oh one", "101"), ("twenty one", "21"), ("two hundred and five", "205"), ("one thousand two hundred", "1200"), ("million million", "1000000"),
    ("nineteen sixty four", "1964"), ("nineteen sixties", "1960s"), ("twenty twenty", "2020"), ("twenty one two", "212"), ("triple zero", "000"),
    ("double seven", "77"), ("double trouble", "double trouble"), ("double hundred", "double 100"), ("three point one four", "3.14"), ("three point one", "3.one"),
    ("point five", ".5"), ("point hundred", "100"), ("two point five million", "2500000"), ("two and a half", "2.5"), ("one and a half", "one.5"),
    ("and a half cup", "cup"), ("cup and a half", "cup and a half"), ("minus five", "-5"), ("minus five dollars", "$5"), ("minus and x", "-and x"),
    ("plus dollars", "+dollars"), ("20 million dollars", "$20000000"), ("one dollar", "$one"), ("two dollars and seven cents", "$2.07"),
    ("zero dollars and seven cents", "¢7"), ("5 per cent", "5%"), ("two per day", "2 per day"), ("one hundred percent", "100%"), ("$2 and ¢7", "$2.07"),
    ("first second third", "1st 2nd 3rd"), ("twenty first", "21st"), ("five and six", "5 and 6"), ("five thousand million", "5000"), ("ninth", "ninth"),
    ("eighth", "8th"), ("hundreds", "100s"), ("two hundredth", "200th"), ("007", "7"), ("10.1", "10.one"), ("1st", "1st"), ("b2b", "b 2 b"), ("one", "one"),
    ("ones", "ones"), ("oh no", "0 no"), ("", ""),
]
TEXTS = [
    ("Mr. Smith isn't here.", "mister smith is not here "), ("[noise] uh I'm gonna go (laughs)", "i am going to go"), ("They won't; she'd been there", "they will not she had been there"),
    ("St. John's", "saint john is"), ("It costs $1,000.50", "it costs $1000.50"), ("1,2,3", "12 3"), ("a..b", "a b"), ("version 2.0.", "version 2"), ("50% off", "50% off"),
    ("It's 5 o'clock", "it is 50 clock"), ("Café Œuvre naïve", "cafe oeuvre naive"), ("Þórr", "thorr"), ("rock ’n’ roll", "rock n roll"), ("()", ""), (None, None),
]


def read(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return [r["n"] for r in d.select("k", numbers.standardized(F.col("t")).alias("n")).orderBy("k").collect()]


def test_numbers(spark):
    assert read(spark, [t for t, _ in NUMBERS]) == [w for _, w in NUMBERS]
    assert [standardize(t) for t, _ in NUMBERS] == [w for _, w in NUMBERS]


ODD = (
    "x cup half a 12 0 007 3.14 $20 -5 +7 ¢5 £0.07 10.0 1st b2b 99 999 ٣ ٣.٥ 100 1000 5000 123456789012345678901234567890 999999999999999999999999999999999999999999 $0 0.05"
    " . % - $ -x cent per and point double triple"
).split() + ["and a half"]


@pytest.mark.parametrize("seed", range(3))
def test_numbers_in_any_order(spark, seed):
    rng = random.Random(seed)
    every = list(numbers.LEXICON)
    small = [w for w in every if numbers.LEXICON[w][0] in ("unit", "ten", "power", "zero", "special", "currency")]
    texts = [(" " if rng.random() < 0.9 else "  ").join(rng.choice(lexicon if rng.random() < 0.85 else ODD) for _ in range(rng.randint(0, 10))) for lexicon in (every, small) for _ in range(1500)]
    assert read(spark, texts) == [standardize(t) for t in texts]


def test_no_python_in_the_plan(spark):
    d = spark.createDataFrame([("é two",)], "t string")
    plan = normalize.with_normalized(d, "t", "n")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_normalized(spark):
    d = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(TEXTS)], "k int, t string")
    got = {r["k"]: r["n"] for r in d.select("k", normalize.normalized(F.col("t")).alias("n")).collect()}
    assert [g if g is None else g.strip() for _, g in sorted(got.items())] == [w if w is None else w.strip() for _, w in TEXTS]


def test_gate_changes_nothing(spark):
    texts = [t for t, _ in NUMBERS] + ["plain words and  more", "half of it", "sand a half", "٣ things", "and a half"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = d.select("t", numbers.standardized(F.col("t")).alias("n"), numbers.may_hold_numbers(F.col("t")).alias("g")).collect()
    assert [r["n"] for r in got] == [standardize(t) for t in texts]
    assert not got[-5]["g"]


@pytest.mark.parametrize(("text", "want"), [("$20 5%", ["$", "20", "5"]), ("x +5 -5", ["x", "+", "5", "-5"]), ("one.5", ["one", "5"]), ("¢7", ["¢7"]), ("", []), ("A, b!", ["a", "b"])])
def test_scoring_tokens(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(tokens.scoring_tokens(F.col("t"))).first()[0] == want


def test_characters_and_names(spark):
    assert spark.createDataFrame([("a b",)], "t string").select(tokens.tokenized(F.col("t"), "none", characters=True)).first()[0] == "a ▁ b"
    with pytest.raises(ValueError, match="unknown"):
        tokens.tokenized(F.lit("x"), "nope")


def test_spelling(spark):
    d = spark.createDataFrame([(1, "the colour  grey"), (2, ""), (3, None), (4, "colour colour")], "k int, t string")
    table = spark.createDataFrame([("colour", "color"), ("grey", "gray")], "src string, dst string")
    out = {r["k"]: r["u"] for r in normalize.plain_spelling(d, "t", table, "u").collect()}
    assert out == {1: "the color gray", 2: "", 3: None, 4: "color color"}
    assert [r[0] for r in d.orderBy("k").select(normalize.spelled(F.col("t"), {"colour": "color", "grey": "gray"})).collect()] == [out[k] for k in (1, 2, 3, 4)]


def test_halves_and_cents(spark):
    cases = {
        "two and a half": "2.5", "and a half": "", "cup and a half": "cup and a half", "two and a half and a half": "2.5", "x and a half y": "x and a half y",
        "million and a half dollars": "$1000000.5", "two dollars and seven cents": "$2.07", "two dollars seventy cents": "$2.70", "five cents": "¢5", "a1b": "a one b", "3 rd": "3rd",
    }
    assert dict(zip(cases, read(spark, list(cases)), strict=True)) == cases


def test_a_large_dictionary(spark, tmp_path):
    """100,000 words, repeated ones among them: the last counts, as in a JSON object."""
    import json

    body = ", ".join(f"{json.dumps(f'w{k}')}: {json.dumps(f'v{k}')}" for k in range(100_000))
    (tmp_path / "m.json").write_text("{" + body + ', "w5": "zzz", "w7": "b", "w7": "a", "é": "e"}')
    table = annotations.read_lookup(spark, f"{tmp_path}/m.json")
    d = spark.createDataFrame([(1, "w5  w99999 none"), (2, "w7 w7 é"), (2, "w7 w7 é"), (3, None), (4, " "), (5, " ".join(f"w{k}" for k in range(0, 100_000, 7)))], "k int, t string")
    got = sorted((r["k"], r["u"]) for r in normalize.plain_spelling(d, "t", table, "u").collect())
    assert got[:-1] == [(1, "zzz v99999 none"), (2, "a a e"), (2, "a a e"), (3, None), (4, "")]
    assert got[-1][1].split() == [{5: "zzz", 7: "a"}.get(k, f"v{k}") for k in range(0, 100_000, 7)]


def test_spelling_keeps_columns_of_its_own_names(spark):
    d = spark.createDataFrame([("a b", 1, 2, 3, 4)], "t string, __key int, __text int, word int, at int")
    table = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "z"), ("b", None)], "src string, dst string")
    assert [r.asDict() for r in normalize.plain_spelling(d, "t", table, "t").collect()] == [{"t": "y b", "__key": 1, "__text": 2, "word": 3, "at": 4}]


def test_one_look_finds_whatever_a_pattern_would(spark):
    forms = [*normalize.BRACKETS, *normalize.FILLERS, *normalize.FULL_FORMS]
    words = ["<a>", "[b]", "(c)", "hmm", "mm", "um", "uh,", "mhm", "x 'y", "won't", "wanna", "gotta", "gonna", "imma", "woulda", "coulda", "shoulda", *(f"{s}." for s, _ in normalize.TITLES), "é'd", "plain", "ümm", "1,234.", "3.5", "１,２"]
    texts = spark.createDataFrame([(w,) for w in [*words, *(f"a {w} b" for w in words), ""]] + [(None,)], "t string")
    for sign, pairs in ((normalize._SPOKEN_FORM, forms), ("[,.]", normalize.STOPS)):
        assert texts.where(~normalize.replaced_where(F.col("t"), sign, pairs).eqNullSafe(normalize.replaced(F.col("t"), pairs))).count() == 0


def test_prices_of_one_file_are_dealt_to_tasks(spark):
    from loomtext.plans import text_queries

    prices = text_queries._spoken_prices(spark, "/root/testdata/sf0.01")
    assert prices.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1

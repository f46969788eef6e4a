import random
import zlib

import numpy as np

from loomtext.llm import langid


def greedy(text, train):
    """Phrases of a cross-parse by plain substring search over letter arrays."""
    phrases, at, n = 0, 0, len(text)
    s = bytes(train)
    while at < n:
        size = 1
        while at + size <= n and bytes(text[at : at + size]) in s:
            size += 1
        phrases += 1
        at += max(1, size - 1)
    return phrases


def test_parse_against_search():
    rng = random.Random(1)
    text = lambda letters: "".join(rng.choice(letters) for _ in range(400))
    by = {lang: ([text(letters) for _ in range(2)], [text(letters)]) for lang, letters in (("x", "abcd "), ("y", "cdef "), ("z", "éaß "))}
    model = langid.build(by)
    texts = ["".join(rng.choice("abcdefé 1") for _ in range(rng.randrange(1, 90))) for _ in range(60)] + ["a", "q" * 30, "", "abcd" * 50]
    letters = [model.encode(t) for t in texts]
    for piece in (1, 3, 8, 512):
        got = model.phrases(letters, piece)
        for k, lang in enumerate(model.languages):
            train = model.encode(" ".join(by[lang][0]))
            assert got[:, k].tolist() == [greedy(p.tolist(), train.tolist()) for p in letters]


def test_pieces_that_never_agree():
    """A text that is one phrase: no piece begins where the whole does."""
    rng = random.Random(2)
    whole = "".join(rng.choice("ab") for _ in range(600))
    model = langid.build({"x": ([whole], [whole])})
    assert model.phrases([model.encode(whole), model.encode(whole[3:500])], 16).tolist() == [[1], [1]]


def test_many_letters_and_languages():
    rng = random.Random(3)
    wide = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    far = [chr(c) for c in range(0x10330, 0x1034A)]
    by = {f"l{k:03}": ([text := " ".join("".join(rng.choice(own) for _ in range(4)) for _ in range(60))], [text]) for k, own in enumerate([wide[13 * k : 13 * k + 13] for k in range(230)])}
    by["far"] = ([" ".join("".join(rng.choice(far) for _ in range(4)) for _ in range(60))], [])
    model = langid.build(by)
    said = model.judge(["".join(wide[13 * k : 13 * k + 9]) for k in range(230)] + ["".join(far[:9]), "½ ² 3", None])
    assert [x[0] for x in said] == [f"l{k:03}" for k in range(230)] + ["far", "und", "und"]


def test_shares():
    assert langid.shares([5, 100, 50, 1], 60) == [5, 27, 27, 1]
    assert langid.shares([5, 6], 100) == [5, 6] and langid.shares([], 5) == []


def test_few_long_labelled_texts(spark):
    """A language of one long document, whose opening is that of the others; repeated rows of one id."""
    opening = "alpha beta gamma delta " * 100
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 7)))
    body = lambda letters, n: " ".join(word(letters) for _ in range(n))
    rows = [(1, opening + body("rstlne", 4000), "a")] + [(2, opening + body("bcdfgk", 3000), "b")] * 30 + [(None, body("mopquv", 300), "c")] * 3
    rows += [(10, body("rstlne", 60), None), (11, body("bcdfgk", 60), None), (12, body("mopquv", 60), None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r[0]: r[1] for r in langid.identify(d, langid.F.lit(False)).select("row.doc_id", "lang_pred").collect()}
    assert (got[10], got[11], got[12]) == ("a", "b", "c")


def test_cases(spark):
    english = "the cat sat on the mat and the dog ran after it while everyone was looking at them with great interest "
    german = "der hund lief über die wiese und die katze schlief auf dem sofa weil es draußen kalt und ungemütlich war "
    rows = [(i, (english if i % 2 else german) * 3, "en" if i % 2 else "de", 1) for i in range(20)]
    rows += [(100, None, None, None), (101, "", "en", 1), (102, "12 !! 34", "de", 1), (103, english.upper() * 2000, None, 1), (None, german, None, 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: (r["lang_pred"], r["s"]) for r in langid.identify(d, langid.F.lit(False)).select("row.doc_id", "lang_pred", langid.F.col("score").alias("s")).collect()}
    assert [got[k][0] for k in (100, 101, 102, 103, None, 1, 2)] == ["und", "und", "und", "en", "de", "en", "de"]
    assert all(0 <= s <= 1 for _, s in got.values()) and got[100][1] == 0
    assert {r["lang_pred"] for r in langid.identify(d, langid.F.lit(True)).collect()} == {"und"}
    assert langid.identify(d.limit(0), langid.F.lit(False)).count() == 0


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.01"
    lang = {r[0]: r[1] for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "lang").collect()}
    rows = langid.op7(spark, at).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in out]) >= 0.97


def test_pieces_that_do_not_agree_are_not_parsed_again(monkeypatch):
    """One odd text among others adds no steps beyond those of two pieces; what comes out doesn't depend on how many go one by one."""
    rng = random.Random(5)
    whole = "".join(rng.choice("ab") for _ in range(900))
    words = [" ".join("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(120)) for _ in range(6)]
    by = {"x": ([whole], [whole]), "y": (["abcd " * 40 + words[0]], [words[1]]), "z": (["ba dc " * 9 + "é" * 40], ["cab"])}
    model = langid.build(by)
    texts = [model.encode(t) for t in (whole, whole[3:700] + words[2] + whole[5:800], "abcd" * 200, words[3] + "ba dc " * 90, "é" * 300, "ab" * 300 + whole[:200] * 3, "q" * 200, words[4])]
    want = [[greedy(t.tolist(), model.encode(" ".join(by[k][0])).tolist()) for k in model.languages] for t in texts]
    steps, real = [], langid.Model._step
    monkeypatch.setattr(langid.Model, "_step", lambda self, *a: (steps.append(1), real(self, *a))[1])
    for piece in (1, 4, 16, 64):
        for few in (0, 3, 10**9):
            monkeypatch.setattr(langid, "FEW", few)
            steps.clear()
            assert model.phrases(texts, piece).tolist() == want
            assert len(steps) <= 2 * piece

import hashlib
import re

import pytest

from loomtext.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    out = {}
    for doc, text in docs:
        w = WORD.findall(lower(text))
        hit, ids = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    ids |= own
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(ids), sha, len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.judge(d, b, **more).select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    return {r[0]: tuple(r[1:]) for r in rows}


LONG = " ".join(f"w{i}" for i in range(30))


@pytest.mark.parametrize("more", [{}, {"block_words": 5}])
def test_cases(spark, more):
    docs = [
        (1, None), (2, ""), (3, "... !!"), (4, f"before {LONG.upper()} after"), (5, LONG[:40]),
        (6, f"{LONG} x {LONG}"), (7, "Kurz, Text"), (8, "the kurz text the the"), (9, "straße W1-w2 É"),
        (10, " ".join(["pad"] * 700) + " " + " ".join(f"w{i}" for i in range(13))), (11, "one"), (12, "One one ONE two"),
    ]
    items = [(100, LONG), (101, "kurz text"), (102, None), (103, "?!"), (104, "one"), (105, "one"), (20, f"zz {LONG} yy"), (106, "Straße w1 w2")]
    assert run(spark, docs, items, **more) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == {}
    assert run(spark, [(1, "a b")], []) == brute([(1, "a b")], [])


def test_locations(spark):
    d = spark.createDataFrame([(1, f"a b {LONG} c", 9, "x")], "doc_id long, text string, matches int, n_words string")
    b = spark.createDataFrame([(7, LONG), (8, None)], "item_id long, text string")
    row = decontaminate.matches(d, b).first()
    assert [tuple(m) for m in row["matches"]] == [("7", 2, 30)] and row["n_words"] == 33 and row["row"]["n_words"] == "x"


def test_columns_and_filter(spark):
    d = spark.createDataFrame([(1, LONG, 5), (2, "clean", 6), (None, None, None)], "doc_id long, text string, row int")
    b = spark.createDataFrame([(7, LONG, 1)], "item_id long, text string, doc_id int")
    kept = decontaminate.decontaminate(d, b)
    assert kept.columns == ["doc_id", "text", "row"]
    assert sorted(r["text"] or "" for r in kept.collect()) == ["", "clean"]


def test_clashing_names_and_repeated_rows(spark):
    schema = "doc_id long, text string, n_words int, n_hit string, matches int, row int, item_id int, contaminated string, text_ string"
    d = spark.createDataFrame([(1, LONG, 1, "h", 2, 3, 4, "c", "t")] * 3 + [(None,) * 9] * 2 + [(2, "x " * 300_000 + LONG, None, None, None, None, None, None, None)], schema)
    b = spark.createDataFrame([(7, LONG, 1)] * 2 + [(None, None, None), (None, "zz yy", None)], "item_id long, text string, n_words int")
    rows = decontaminate.judge(d, b).select("row.doc_id", decontaminate.F.col("n_words").alias("n"), "n_hit", "contaminated").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, 30, 30, True)] * 3 + [(None, 0, 0, False)] * 2 + [(2, 300_030, 30, False)], key=str)
    assert decontaminate.decontaminate(d, b).columns == d.columns


def test_table(spark):
    at = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{at}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in decontaminate.op8(spark, at).collect()}
    assert got == brute(docs, items)
    assert any(v[-1] for v in got.values())

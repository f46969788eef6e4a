"""Every operator over rows that are null, empty, tied, repeated, long, and have columns of its own names."""

from collections import Counter

import pytest
from odd import odd_rows, plain

from loomtext.llm import decontaminate, html_text, jaccard_join, langid, lm, mixing, quality, substring_dedup, toxicity, urls
from loomtext.llm.toxicity import F


def some(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def labels(spark):
    return some(spark, "doc_id long, quality int, toxic int, text string", (1, 1, 0, "?"), (2, 0, 1, None), (2, 1, None, None), (None, None, None, None), (6, 1, 1, "a"))


OPERATORS = {
    "op2": lambda s, d: mixing.mix(d),
    "op3": lambda s, d: lm.score_texts(d, F.col("doc_id") == 1),
    "op4": lambda s, d: toxicity.judge(d, labels(s), F.col("doc_id") == 1),
    "op5": lambda s, d: substring_dedup.remove_repeats(d),
    "op6": lambda s, d: urls.judge(d),
    "op7": lambda s, d: langid.identify(d, F.col("doc_id") == 1),
    "op8": lambda s, d: decontaminate.judge(d, some(s, "item_id long, text string, row int", (1, "another text of few", 1), (None, None, None), (2, "", 1))),
    "op9": lambda s, d: quality.judge(d, labels(s)),
    "op10": lambda s, d: html_text.extract(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_come_back(spark, name):
    d = odd_rows(spark)
    rows = OPERATORS[name](spark, d).collect()
    assert Counter(plain(r["row"]) for r in rows) == Counter(plain(r) for r in d.collect())
    # equal rows get equal results, but that the mix takes parts of one queue
    if name != "op2":
        assert len({str(tuple(r)) for r in rows}) == len({plain(r["row"]) for r in rows})
    assert OPERATORS[name](spark, d.limit(0)).count() == 0


def test_join(spark):
    d = odd_rows(spark)
    rows = Counter((r["doc_id"], r["component_id"]) for r in jaccard_join.components(d).collect())
    # the rows that share id 2 have a component each; rows without id are linked, but lend no id
    assert rows == {(1, 1): 2, (2, 1): 1, (2, 2): 1, (None, 1): 1, (None, None): 2, (3, 3): 1, (4, 4): 1, (5, 5): 1, (6, 6): 1, (7, 6): 1, (8, 8): 1}
    assert jaccard_join.components(d.limit(0)).count() == 0

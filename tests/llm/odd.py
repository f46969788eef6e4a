"""Rows that no operator may crash on."""

import random

CLASHES = (
    "row blk held_out score size source_size target taken n_words n_removed kept_text kept_sha256 matches n_hit contaminated sig n gram pos label node"
    " component_id n_shingles host path rule verdict words predicted kept llr base_failed lang_pred item_id url html page_id name chunk bucket"
).split()


def odd_rows(spark):
    """Null, empty and blank texts, null ids, ids that several texts share, repeated rows, a text of 100,000 words."""
    rng = random.Random(1)
    words = [f"word{i}" for i in range(400)]
    one = " ".join(rng.choice(words) for _ in range(90))
    long = " ".join(rng.choice(words) for _ in range(100_000))
    rows = [(1, one), (1, one), (2, one), (2, "another text of few words"), (3, None), (None, None), (None, None), (4, ""), (5, " \n\t "), (None, one), (6, long), (7, long + " end"), (8, "é" * 3000)]
    kinds = ["string", "int", "array<int>", "double", "boolean"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} {kinds[k % 5]}" for k, c in enumerate(CLASHES))
    values = {"string": "x", "int": 1, "array<int>": [1], "double": 0.5, "boolean": True}
    more = [values[kinds[k % 5]] for k in range(len(CLASHES))]
    out = [(d, t, "en" if d else None, "s" if d and d % 2 else None, len(t or ""), *(more if d else [None] * len(more))) for d, t in rows]
    return spark.createDataFrame(out, schema)


def plain(row):
    return str(tuple(row))

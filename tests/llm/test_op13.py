import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomtext.llm import vector_codes

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=256, parts=4, rounds=4):
    """Python's integers, one distance at a time."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    sizes = Counter(len(v) for _, v, _ in kept)
    dims = max(sizes, key=lambda n: (sizes[n], n))
    kept = [(i, v + [0] * (-len(v) % parts), label) for i, v, label in kept if len(v) == dims]
    width = len(kept[0][1]) // parts
    least = {}
    for i, v, _ in kept:
        least[i] = min(v, least.get(i, v))
    start = sorted(least, key=lambda i: (i is None, i or 0))[:entries]
    books = [[least[i][p * width : (p + 1) * width] for i in start] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assigned():
        return [[min((far(v[p * width : (p + 1) * width], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        found = assigned()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p * width : (p + 1) * width] for (_, v, _), f in zip(kept, found, strict=True) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = assigned()
    by_label = Counter()
    for (_, _, label), f in zip(kept, found, strict=True):
        by_label[label] += sum(d for d, _ in f)
    return Counter((i, label, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by_label[label], digest) for (i, _, label), f in zip(kept, found, strict=True))


def made(seed, n, dims):
    rng = random.Random(seed)
    centers = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    one = lambda: [float(np.float32(x + rng.gauss(0, 0.1))) for x in rng.choice(centers)]
    rows = [(rng.randrange(n), one(), rng.choice([None, 1, 2])) for _ in range(n)]
    rows += [rows[0], rows[0], (5, None, 1), (6, [], 1), (7, [None] + one()[1:], 1), (8, [float("nan")] + one()[1:], 2), (9, [float("-inf")] + one()[1:], 2), (None, one(), 3), (3, one()[:-1], None)]
    return rows


@pytest.mark.parametrize(("seed", "n", "dims", "entries"), [(1, 300, 8, 256), (2, 400, 10, 16), (3, 3, 4, 256), (4, 60, 3, 8)])
def test_like_brute_force(spark, seed, n, dims, entries):
    rows = made(seed, n, dims)
    got = vector_codes.compress(spark.createDataFrame(rows, KIND).repartition(5), entries=entries).collect()
    assert Counter(map(tuple, got)) == brute(rows, entries)


def test_table(spark):
    at = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert Counter(map(tuple, vector_codes.op13(spark, at).collect())) == brute(rows)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], KIND)
    assert vector_codes.compress(empty).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1), (2, [None], 2)], KIND)).count() == 0
    clash = spark.createDataFrame([(1, [0.5, 0.25, 0.1, -0.1], 1, "x", 2), (2, [0.5, 0.25, 0.1, -0.2], None, "y", 3)], f"{KIND}, code string, vector int")
    assert Counter(map(tuple, vector_codes.compress(clash).collect())) == brute([(1, [float(np.float32(x)) for x in (0.5, 0.25, 0.1, -0.1)], 1), (2, [float(np.float32(x)) for x in (0.5, 0.25, 0.1, -0.2)], None)])
    assert vector_codes.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0])], "vec_id int, embedding array<double>")).count() == 1
    named = spark.createDataFrame([(1, [0.5, 1.0], "a"), (2, [0.5, 2.0], None)], "vec_id int, embedding array<double>, label string")
    assert {(r["vec_id"], r["label"]) for r in vector_codes.compress(named).collect()} == {(1, "a"), (2, None)}
    with pytest.raises(ValueError, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 4, 1)], KIND))


def test_ties_and_round_trip():
    books = vector_codes.Codebooks([np.array([[3], [1], [1], [5]]), np.array([[0], [2], [4], [-9]])], 2)
    codes, error = books.nearest(np.array([[2, 1], [1, 3], [4, -9]]))
    assert codes.tolist() == [[0, 0], [1, 1], [0, 3]] and error.tolist() == [2, 1, 1]
    assert vector_codes.decode(pa.array(["0003", "0101"]), books).tolist() == [[3 / 1024, -9 / 1024], [1 / 1024, 2 / 1024]]

import random

from brute import SPACED

from loomtext.llm import mixing


def fair(sizes, weights):
    """Targets by repeated sharing."""
    budget, out, open_ = sum(sizes.values()), {}, dict(weights)
    while open_:
        level = (budget - sum(out.values())) / sum(open_.values())
        over = [s for s in open_ if level * open_[s] >= 3 * sizes[s]]
        if not over:
            return out | {s: level * w for s, w in open_.items()}
        for s in over:
            out[s] = 3 * sizes[s]
            del open_[s]
    return out


def check(rows, docs):
    size = [len(SPACED.findall(t or "")) for _, t, _ in docs]
    per = {}
    for (_, _, s), n in zip(docs, size):
        per[s] = per.get(s, 0) + n
    names = sorted((s for s in per if s is not None), key=lambda s: s.encode()) + [None] * (None in per)
    want = fair(per, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    assert sorted(r["size"] for r in rows) == sorted(size)
    taken = {}
    source = {d: s for d, _, s in docs}
    for r in rows:
        s = source[r["doc_id"]]
        taken[s] = taken.get(s, 0) + r["taken"]
        assert r["source_size"] == per[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in per)


def test_random(spark):
    rng = random.Random(1)
    docs = [(i, " ".join("w" * rng.randrange(1, 300)), rng.choice(["a", "a", "a", "a", "b", "Z", "é", None, "c"])) for i in range(300)]
    docs += [(1000, None, "empty"), (1001, "", "empty"), (1002, "\x0b ", "a")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = mixing.mix(d)
    rows = out.select("row.doc_id", "size", "source_size", "target", "taken").collect()
    check(rows, docs)
    again = mixing.mix(d.repartition(7)).select("row.doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_stream_is_in_order_and_whole(spark):
    docs = [(i, "s0" if i % 3 else "s1", i % 7) for i in range(200)]
    d = spark.createDataFrame(docs, "doc_id long, source string, size long")
    out = mixing.stream(d).collect()
    assert [r["mix_finish"] for r in out] == sorted(r["mix_finish"] for r in out)
    assert abs(sum(r["mix_taken"] for r in out) - sum(x[2] for x in docs)) <= 2
    assert all(r["mix_taken"] for r in out)


def brute_mix(docs, share):
    """(doc_id, taken) by putting every part in order and cutting at the budget; docs are (doc_id, source, size)."""
    import hashlib
    import math

    per = {}
    for _, s, n in docs:
        per[s] = per.get(s, 0) + n
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(per))}
    target, parts = fair(per, weights), []
    quota = {s: math.floor(target[s] * share) for s in per}
    for s in sorted(per, key=lambda s: (quota[s] - target[s] * share, s))[: int(sum(per.values()) * share) - sum(quota.values())]:
        quota[s] += quota[s] < 3 * per[s]
    for s in per:
        own = sorted((hashlib.md5(str(d).encode()).hexdigest(), d, n) for d, x, n in docs if x == s)
        at = 0
        for k in range(3):
            for _, d, n in own:
                at += n
                finish, first = at / target[s], max(0, min(n, quota[s] - at + n))
                parts += [(min(finish, share), s, d, first), (finish, s, d, n - first)]
    left, out = int(sum(per.values()) * share), {d: 0 for d, _, _ in docs}
    for _, _, d, n in sorted(p for p in parts if p[3]):
        out[d] += min(n, left)
        left -= min(n, left)
    return out


def test_truncated_in_order_of_finish(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["a", "a", "b", "c", "d"]), rng.randrange(1, 90)) for i in range(150)]
    d = spark.createDataFrame(docs, "doc_id long, source string, size long")
    for share in (1.0, 0.37, 0.05):
        rows = mixing.schedule(d, share=share).collect()
        assert {r["row"]["doc_id"]: sum(c["taken"] for c in r["copies"]) for r in rows} == brute_mix(docs, share)


def test_edges(spark):
    schema = "doc_id long, text string, source string, size string, row int, target int"
    d = spark.createDataFrame([(1, "a b c", "x", "?", 1, 1), (1, "a b c", "x", "?", 1, 1), (None, None, None, None, None, None)], schema)
    rows = mixing.mix(d).select("row.*", "taken").collect()
    assert len(rows) == 3 and sum(r["taken"] for r in rows) == 6 and rows[0].__fields__[:6] == ["doc_id", "text", "source", "size", "row", "target"]
    assert mixing.mix(d.limit(0)).count() == 0
    assert all(r["taken"] == 0 for r in mixing.mix(d.where("doc_id is null")).collect())


def test_table(spark):
    at = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text", "source").collect()]
    check(mixing.op2(spark, at).collect(), docs)


def test_against_sql(spark):
    import duckdb

    at = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{at}/documents.parquet')")
    want = sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in con.execute(mixing.ORACLE).fetchall())
    got = sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.op2(spark, at).collect())
    assert got == want

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import bigram_score, unigram_base
from pyspark.sql import functions as F

from loomtext.llm import lm


def test_trie_round_trip():
    rng = np.random.default_rng(1)
    context, word = rng.integers(0, 50, 4000).astype(np.uint64) ** 5, rng.integers(0, 1 << 40, 4000).astype(np.uint64)
    pairs = np.unique(np.stack([context, word], 1), axis=0)
    codes = rng.integers(0, 255, len(pairs))
    trie = lm.Trie.from_buffer(lm.Trie.build(pairs[:, 0], pairs[:, 1], codes).to_bytes())
    assert (trie.find(pairs[:, 0], pairs[:, 1]) == codes).all()
    assert (trie.find(pairs[:, 0], pairs[:, 1] + np.uint64(1)) == lm.NONE).mean() > 0.99
    assert (trie.find(pairs[:, 0] + np.uint64(1), pairs[:, 1]) == lm.NONE).mean() > 0.9
    assert len(lm.Trie.build(pairs[:0, 0], pairs[:0, 1], codes[:0]).find(pairs[:, 0], pairs[:, 1])) == len(pairs)


@pytest.mark.parametrize("top", [10, 300, 1 << 20, 1 << 45, (1 << 64) - 1])
def test_levels_are_searched_as_they_are(top, tmp_path):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 2, 700, 5000):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        path = tmp_path / f"{n}"
        path.write_bytes(lm.EliasFano.encode(values).to_bytes())
        level, _ = lm.EliasFano.read(np.memmap(path, np.uint8, "r"), 0)
        assert (level.get(np.arange(n)) == values).all()
        asked = np.concatenate([values, values + np.uint64(1), values - np.uint64(1), rng.integers(0, top, 300, dtype=np.uint64, endpoint=True), np.array([0, top, (1 << 64) - 1], np.uint64)])
        at, equal = level.search(asked)
        if n:
            assert (at == np.searchsorted(values, asked)).all()
            assert (equal == np.isin(asked, values)).all()


def test_every_pair_comes_through_a_trie(spark, monkeypatch):
    """Without answers of the tries all pairs are unseen."""
    rows = [(i, f"a b c{i} d{i} a b", False) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    table = pa.table({"doc_id": [1], "text": ["a b c d"], "held_out": [False]})
    block = lm.Block(table)
    block.pairs()
    assert len(block.pair) == 5
    found = []
    plain = lm.Trie.find
    monkeypatch.setattr(lm.Trie, "find", lambda self, c, w: (found.append(len(c)), plain(self, c, w))[1])
    n = len(block.keys)
    answers = pa.table({"kind": pa.array([0], pa.int32()), "bucket": pa.array([0], pa.int32()), "answer": [(2 * block.own).astype(np.int64).tobytes()]})
    none = pa.table({"kind": pa.array([1], pa.int32()), "bucket": pa.array([0], pa.int32()), "answer": [b""]})
    whole = table.append_column("row", pa.array([{"doc_id": 1, "text": "a b c d"}]))
    scored = lm._score(1, 5, n)(whole.drop_columns(["doc_id", "text"]), pa.concat_tables([answers, none]))
    assert found == [5] and scored.num_rows == 1
    monkeypatch.undo()
    check(rows, lm.score_texts(d, F.col("held")).select("row.doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect())


def check(rows, got):
    base, full = unigram_base(rows), bigram_score(rows, lm.MU)
    assert len(got) == len(rows)
    for r in got:
        n, known, total, score = base[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(score, rel=1e-9)
        assert r["score"] == pytest.approx(full[r["doc_id"]], rel=0.02, abs=0.03 * n)


@pytest.mark.parametrize("size", [1 << 20, 3])
def test_small(spark, size, monkeypatch):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary[: rng.randrange(2, 60)]).upper() for _ in range(rng.randrange(40))), i % 5 == 1) for i in range(80)]
    rows += [(100, None, False), (101, "", True), (102, "never seen words", True)]
    monkeypatch.setattr(lm, "SLICE", size)
    d = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    check(rows, lm.score_texts(d, F.col("held")).select("row.doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect())


def test_edges(spark):
    d = spark.createDataFrame([(1, "a b", 3), (None, None, None)], "doc_id long, text string, answer int")
    assert lm.score_texts(d, F.lit(True)).where("n_known = 0 and train_tokens = 0").count() == 2
    assert lm.score_texts(d, F.lit(False)).select("row.*").columns == d.columns
    assert lm.score_texts(d.limit(0), F.lit(False)).count() == 0


def test_table(spark):
    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()
    rows = [(d, t, zlib.crc32(str(d).encode()) % 5 == 1) for d, t in docs]
    got = lm.op3(spark, at).collect()
    check(rows, got)
    assert {r["doc_id"]: r["held_out"] for r in got} == {d: h for d, _, h in rows}
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)

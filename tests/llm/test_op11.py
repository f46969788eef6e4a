import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from odd import odd_rows
from tokenizers import Tokenizer

from loomtext.llm import packing, token_ids

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def ids_of(tokenizer, texts):
    return [[*e.ids, 1] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_like_the_tokenizer(tokenizer, monkeypatch):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", " \n", "a", "Bc", "é", "中", "'s", "'", " 's", "<|endoftext|>", "1", "23", ".", "!?", "\t", " ", "　", "​", "\x85", "\x1c", "don't", "\r\n", "🙂", "᠎", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["", " ", "  ", "a ", " a"]
    own = token_ids.TokenIds(FILE)
    assert [x.tolist() for x in own.ids(texts)] == ids_of(tokenizer, texts)
    # long texts in segments, a table that is emptied
    monkeypatch.setattr(token_ids, "RUN", 200)
    monkeypatch.setattr(token_ids, "TABLE", 3000)
    texts = ["".join(rng.choice(parts) for _ in range(600)) for _ in range(100)] + ["x" * 5000, " " * 3000]
    assert [x.tolist() for x in own.ids(texts)] == ids_of(tokenizer, texts)


def first_fit(sizes, length):
    left, seats = [], []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        seat = next((s for s, room in enumerate(left) if room >= sizes[k]), len(left))
        if seat == len(left):
            left.append(length)
            seats.append([])
        left[seat] -= sizes[k]
        seats[seat].append(k)
    return seats


@pytest.mark.parametrize("seed", range(20))
def test_tournament(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, rng.choice([5, 40, 64])) for _ in range(rng.randint(0, 200))]
    packed = packing.first_fit_decreasing(sizes, 64)
    assert packed == first_fit(sizes, 64)
    out = packing.closed([[(k, 0, sizes[k]) for k in s] for s in packed], 64, 2)
    cover = sorted((k, at + i) for s in out for k, at, n in s for i in range(n))
    assert cover == [(k, i) for k, n in enumerate(sizes) for i in range(n)]
    fill = [sum(p[2] for p in s) for s in out]
    assert all(f & (f - 1) == 0 or 62 <= f <= 64 for f in fill) and all(n > 0 for s in out for _, _, n in s)
    # sequences that first fit has closed stay as they are
    assert all([(k, 0, sizes[k]) for k in s] in out for s in packed if sum(sizes[k] for k in s) >= 62)


def hold(rows, texts, tokenizer, length=2048):
    """Every id of every document in one piece, gapless sequences, little padding."""
    docs = {}
    for (key, text), ids in zip(texts, ids_of(tokenizer, [t for _, t in texts]), strict=True):
        docs.setdefault(key, []).append(ids)
    sequences, ids_by_doc = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        ids_by_doc.setdefault(r["doc_id"], []).append(r)
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= length
    assert ids_by_doc.keys() == docs.keys()
    for key, want in docs.items():
        assert sum(r["length"] for r in ids_by_doc[key]) == sum(map(len, want))
        if len(want) == 1:
            at = 0
            for r in sorted(ids_by_doc[key], key=lambda r: r["start"]):
                own = np.array(want[0][at : at + r["length"]], "<u4")
                assert r["start"] == at and r["doc_tokens"] == len(want[0]) and r["ids_crc32"] == zlib.crc32(own.tobytes())
                assert "ids" not in r or r["ids"] == own.tolist()
                at += r["length"]
    fill = [sum(n for _, n in p) for p in sequences.values()]
    padding = sum(0 if f & (f - 1) == 0 else length - f for f in fill)
    return padding / sum(fill)


def test_table(spark, tokenizer):
    at = "/root/testdata/sf0.01"
    rows = [r.asDict() for r in packing.op11(spark, at).collect()]
    texts = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    assert hold(rows, texts, tokenizer) < 0.008
    again = packing.op11(spark, at).collect()
    assert sorted(map(str, (r.asDict() for r in again))) == sorted(map(str, rows))


def test_odd_rows(spark, tokenizer):
    d = odd_rows(spark)
    rows = [r.asDict() for r in packing.pack(d).collect()]
    hold(rows, [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()], tokenizer)
    assert packing.pack(d.limit(0)).count() == 0
    small = [r.asDict() for r in packing.pack(d, length=64, group=3, slack=0).collect()]
    assert hold(small, [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()], tokenizer, 64) == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(d, length=100)

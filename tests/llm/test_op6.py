import math
import random
import re
from collections import Counter

import pytest
import regex

from loomtext.llm import urls
from loomtext.llm.common import Scratch

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.NET/en/x?y#z", "http://example.net/EN/x", "https://notexample.net/en/", "x://net/", "x://net", "x://net?a/b",
    "http://example.com/de/a#b", "http://sub.example.com/de", "http://sub.example.com/de/", "ftp://foo.org/fr/q", "ftp://foo.org/en/q", "http://Ärger.net/é\n/x", "a://b://c/d",
    "http://x#y/z", "http://x.org?fr/", "http://example.net/en/" + "long/" * 3000, "://", "http:///path",
]


def test_rules(spark):
    d = spark.createDataFrame([(i, u, "<p>some words here</p>", 1) for i, u in enumerate(URLS)], "page_id long, url string, html string, host int")
    for r in urls.judge(d).select("row.page_id", "host", "path", "rule", "verdict").collect():
        host, path = parts(URLS[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == rule(host, path)
        assert r["verdict"] == RULES.get(r["rule"], r["verdict"]) and r["verdict"] in ("allow", "block")
    assert urls.judge(d.limit(0)).count() == 0


def brute_split(log_p, unknown, name):
    if not name:
        return 0.0
    return max((log_p.get(name[:n], unknown * n) + brute_split(log_p, unknown, name[n:]) for n in range(1, len(name) + 1)))


def test_split_is_best():
    counts = dict([("the", 90), ("her", 20), ("there", 30), ("re", 40), ("he", 30), ("in", 60), ("rein", 2)])
    log_p, unknown = {w: math.log(n / 300) for w, n in counts.items()}, math.log(0.1 / 300)
    rng = random.Random(4)
    for name in ["there", "therein", "", "xxthe", *["".join(rng.choice("theriny") for _ in range(9)) for _ in range(60)]]:
        own = urls.split(name, counts, 300)
        assert "".join(own) == name
        assert sum(log_p.get(w, unknown * len(w)) for w in own) == pytest.approx(brute_split(log_p, unknown, name))
        assert not any(a not in counts and b not in counts for a, b in zip(own, own[1:]))
    assert urls.split("xxthe", counts, 300) == ["xx", "the"]


def brute_odds(rows, judged):
    """page_id -> log odds; rows are (page_id, url, html), judged the pages that a rule judges."""
    words = Counter()
    for _, _, page in rows:
        plain = re.sub(r"(?s)<(script|style)\b.*?</\1\s*>|<[^>]*>|&#?\w+;", " ", page or "", flags=re.ASCII)
        words.update(w for w in regex.split(r"[^\p{L}]+", plain.lower()) if len(w) > 1)
    total = sum(words.values()) + 1
    features = {}
    for k, url, _ in rows:
        host, path = parts(url)
        own = [w for p in regex.findall(r"[\p{L}\p{N}]+", host) for w in urls.split(p, words, total)]
        features[k] = [urls.cell(t) for t in urls.tokens(host, path, own)] if host or path else []
    count = {c: Counter(t for k, r in judged.items() if r == c for t in features[k]) for c in ("block", "allow")}
    n = Counter(judged.values())
    prior = math.log((n["block"] + 1) / (n["allow"] + 1))
    p = lambda c, t: math.log((count[c][t] + 1) / (sum(count[c].values()) + urls.CELLS))
    return {k: prior + sum(p("block", t) - p("allow", t) for t in f) for k, f in features.items()}


def test_long_words_rare_words_and_long_labels(spark):
    """A word of 30 letters that stands once, in a label of 200 letters."""
    rare = "donaudampfschifffahrtskapitaen"
    counts = spark.createDataFrame([(rare, 1), ("the", 50), ("cat", 40)], "word string, n long")
    hosts = spark.createDataFrame([(f"thecat{rare}the.org",), ("the" * 60 + "x1.de",), ("",), ("cat.the-xcat.net",)], "name string")
    got = {r["name"]: r["words"] for r in urls.host_words(hosts, counts, Scratch(spark)).collect()}
    assert got == {
        f"thecat{rare}the.org": ["the", "cat", rare, "the", "org"], "the" * 60 + "x1.de": ["the"] * 60 + ["x1", "de"], "cat.the-xcat.net": ["cat", "the", "x", "cat", "net"],
    }
    none = urls.host_words(hosts, counts.limit(0), Scratch(spark)).collect()
    assert {r["name"]: r["words"] for r in none}["cat.the-xcat.net"] == ["cat", "the", "xcat", "net"]


def test_repeated_rows_and_extra_columns(spark):
    schema = "page_id long, url string, html string, name string, words int, log_odds string"
    d = spark.createDataFrame([(1, "http://a.b/c", "<p>x y", "n", 1, "?")] * 3 + [(None,) * 6] * 2, schema)
    rows = urls.judge(d).collect()
    assert len(rows) == 5 and len({(r["host"], r["verdict"], r["log_odds"]) for r in rows}) == 2
    assert urls.judge(spark.createDataFrame([(1,)], "page_id long")).first()["host"] == ""


def test_bayes_learns(spark):
    rows = [(i, f"http://{'badsite' if i % 2 else 'goodsite'}{i}.{'net' if i % 2 else 'org'}/{'xx' if i % 2 else 'fr'}/{i}", "<p>bad good site</p>") for i in range(60)]
    rows += [(100, "http://badsite.info/xx/1", ""), (101, "http://goodsite.info/fr/1", "")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(d).select("row.page_id", "verdict").collect()}
    assert got[100] == "block" and got[101] == "allow"


def test_table(spark):
    at = "/root/testdata/sf0.01"
    want = {r[0]: parts(r[1]) for r in spark.read.parquet(f"{at}/pages.parquet").select("page_id", "url").collect()}
    rows = urls.op6(spark, at).collect()
    assert {r["page_id"]: (r["host"], r["path"]) for r in rows} == want
    assert all(r["rule"] == rule(r["host"], r["path"]) and r["verdict"] == RULES.get(r["rule"], r["verdict"]) for r in rows)
    pages = [tuple(r) for r in spark.read.parquet(f"{at}/pages.parquet").select("page_id", "url", "html").collect()]
    odds = brute_odds(pages, {r["page_id"]: r["verdict"] for r in rows if r["rule"]})
    assert all(r["verdict"] == ("block" if odds[r["page_id"]] > 0 else "allow") for r in rows if not r["rule"] and abs(odds[r["page_id"]]) > 1e-9)
    assert len({r["verdict"] for r in rows if not r["rule"]}) == 2


def test_a_very_long_part(spark):
    """A part of 50,000 letters, and words longer than those that are looked up as they are."""
    rng = random.Random(2)
    long_word = "".join(rng.choice("abcdefgh") for _ in range(200))
    words = ["the", "river", "bank", long_word, long_word[:40]]
    part = "".join(rng.choice([*words[:3], "zq"]) for _ in range(13_000))[:50_000]
    urls_ = [f"http://{part}.org/", f"http://{long_word}river.com/", f"http://the{long_word[:40]}bank.com/", f"http://{long_word[:39]}.com/"]
    d = spark.createDataFrame([(i, u, " ".join(words) + " and the river bank") for i, u in enumerate(urls_)], "page_id long, url string, html string")
    scratch = Scratch(spark)
    counts = urls.word_counts(d)
    own = {r["word"]: r["n"] for r in counts.collect()}
    names = d.select(urls.host_of(urls.F.col("url")).alias("name")).distinct()
    got = {r["name"]: r["words"] for r in urls.host_words(names, counts, scratch).collect()}
    total = sum(own.values()) + 1
    for name, found in got.items():
        assert found == [w for p in name.split(".") for w in urls.split(p, {k: n for k, n in own.items() if k in p}, total)]
    assert got[f"{long_word}river.com"][:2] == [long_word, "river"]
    assert got[f"the{long_word[:40]}bank.com"][:3] == ["the", long_word[:40], "bank"]

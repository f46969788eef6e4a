import pytest

from loomtext.operators import batching
from loomtext.sources import settings

TEXT = '''
# a comment
model:
  path: "some/where # not a comment"   # one
  token: ""
  frozen: True
  second: 0.333
  lora:
    rank: 8
    names: [a, 2, 0.5]
run:
  batch: 8
  device: "cuda"
  empty: ~
'''


def test_settings_and_options(spark, tmp_path):
    (tmp_path / "s.yaml").write_text(TEXT)
    base = settings.read_settings(spark, str(tmp_path / "s.yaml"))
    want = {
        "model": {"path": "some/where # not a comment", "token": "", "frozen": True, "second": 0.333, "lora": {"rank": 8, "names": ["a", 2, 0.5]}},
        "run": {"batch": 8, "device": "cuda", "empty": None},
    }
    assert settings.nested(settings.merged(base)) == want
    given = settings.options(spark, ["run.batch=16", "run.batch=32", "run.device=cpu", "model.lora=none", "model.token='7'", "run.empty.deep=-1e3", "new.one=False"])
    got = settings.nested(settings.merged(base, given))
    assert got["run"] == {"batch": 32, "device": "cpu", "empty": {"deep": -1000.0}} and got["new"] == {"one": False}
    assert got["model"] == {"path": "some/where # not a comment", "token": "7", "frozen": True, "second": 0.333, "lora": None}
    assert settings.nested(settings.merged(base, given, settings.options(spark, ["model.lora.rank=4"])))["model"]["lora"] == {"rank": 4}
    for bad in ("x", "=1"):
        with pytest.raises(ValueError, match="path=value"):
            settings.options(spark, [bad])
    with pytest.raises(ValueError, match="line 1"):
        list(settings.lines("no setting"))


def test_like_a_reader_of_yaml():
    yaml = pytest.importorskip("yaml")
    flat = lambda x, at="": {p: v for k, y in x.items() for p, v in (flat(y, f"{at}{k}.") if isinstance(y, dict) else {f"{at}{k}": y}).items()}
    assert {p: settings.value_of(k, v) for p, k, v in settings.lines(TEXT)} == flat(yaml.safe_load(TEXT))


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_batches_with_and_without_adaptive_execution(spark, adaptive):
    """Places are exact however small partitions are put together, and the same when the table is read again."""
    d = spark.range(1000).selectExpr("(id * 7919) % 1000 as k", "cast(null as int) as batch_id_", "id as __part").repartition(7)
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        out = batching.in_batches(d, "k", 32, "place")
        first, second = ({(r["k"], r["batch_id"], r["place"]) for r in out.collect()} for _ in range(2))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    assert first == second == {(k, k // 32, k % 32) for k in range(1000)}

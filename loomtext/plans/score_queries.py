"""Queries of consensus scores, measurements and arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens
from ..operators import batching, consensus, measurements, scoring
from ..sources import shared
from ..streaming import consensus as running
from ..streaming import word_errors as running_errors
from . import text_queries
from .text_queries import _BENCH, _sql_errors, _sql_words, bench_pairs, table, turns


def _multi(spark, sf_dir):
    """The last assistant turn of a conversation against all its user turns."""
    t = turns(spark, sf_dir)
    last = t.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("x"))
    cand = last.select(F.col("conv_id").alias("id"), F.col("x.text").alias("text"))
    refs = t.where("role = 'user'").select(F.col("conv_id").alias("id"), F.col("turn").alias("ref_idx"), "text")
    return cand.join(refs.select("id").distinct(), "id", "left_semi"), refs.join(cand.select("id"), "id", "left_semi")


def ngram_counts(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return consensus.gram_counts(b, ["id"]).select("id", "n", F.array_join("gram", " ").alias("gram"), "tf")


def doc_freq(spark, sf_dir):
    return consensus.document_frequencies(_multi(spark, sf_dir)[1]).select(F.array_join("gram", " ").alias("gram"), "df")


def _weights(spark, sf_dir):
    _, refs = _multi(spark, sf_dir)
    return consensus.weights(consensus.gram_counts(refs, ["id", "ref_idx"]), consensus.document_frequencies(refs), refs.select("id").distinct().count())


def tfidf_weights(spark, sf_dir):
    return _weights(spark, sf_dir).select("id", "ref_idx", "n", F.array_join("gram", " ").alias("gram"), F.round("w", 6).alias("w"))


def tfidf_norms(spark, sf_dir):
    return _weights(spark, sf_dir).groupBy("id", "ref_idx", "n").agg(F.round(F.sqrt(F.sum(F.col("w") * F.col("w"))), 6).alias("norm"))


def _single(spark, sf_dir):
    return consensus.sentence_scores(*consensus.single(bench_pairs(spark, sf_dir)))


def ciderd_sentence(spark, sf_dir):
    return _single(spark, sf_dir).select("id", F.round("cider_d", 6).alias("cider_d"))


def ciderd_corpus(spark, sf_dir):
    return consensus.corpus_score(_single(spark, sf_dir)).select(F.round("cider_d", 6).alias("cider_d"))


def spider_score(spark, sf_dir):
    return consensus.spider(bench_pairs(spark, sf_dir))


def task_scores(spark, sf_dir):
    """Each task by its own score: of the benchmark pairs every third is a transcript, one in nine of no known task."""
    task = F.when(F.col("id") % 9 == 4, "other").when(F.col("id") % 3 == 0, "asr").otherwise("aac")
    scores = scoring.task_scores(bench_pairs(spark, sf_dir).withColumn("task", task), tokens.words)
    return scores.select("task", "metric", F.round("score", 4).alias("score"))


def ciderd_multi_ref(spark, sf_dir):
    return consensus.sentence_scores(*_multi(spark, sf_dir)).select("id", F.round("cider_d", 6).alias("cider_d"))


#: Batches that a stream of the benchmark comes in.
_BATCHES = 4


def _streamed(spark, sf_dir):
    """A running consensus after a stream of the conversations' samples and its end."""
    last = F.max(F.when(F.col("role") == "assistant", F.struct("turn", "text")))
    said = F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text"))))
    samples = turns(spark, sf_dir).where("conv_id is not null").groupBy(F.col("conv_id").alias("id")).agg(last.alias("x"), said.alias("y")).where("x is not null and size(y) > 0")
    samples = samples.select("id", F.col("x.text").alias("hyp"), F.transform("y", lambda u: u["text"]).alias("refs"))
    state = running.RunningConsensus(spark)
    running.done(state.attach(running.in_batches(spark, samples, f"{state.at}/input", _BATCHES), availableNow=True))
    return state


def ciderd_streamed(spark, sf_dir):
    """Scores after a stream: those of the whole table, however it was split."""
    return _streamed(spark, sf_dir).scores().select("id", F.round("cider_d", 6).alias("cider_d"))


def ciderd_streamed_corpus(spark, sf_dir):
    pairs = bench_pairs(spark, sf_dir).select("id", "hyp", F.array("ref").alias("refs"))
    state = running.RunningConsensus(spark)
    running.done(state.attach(running.in_batches(spark, pairs, f"{state.at}/input", _BATCHES), availableNow=True))
    return state.compute()["corpus"].select(F.round("cider_d", 6).alias("cider_d"))


def ciderd_tfidf(spark, sf_dir):
    """The tf-idf vectors that scores are made of, by reference and order."""
    cand, refs = _multi(spark, sf_dir)
    state = running.RunningConsensus(spark)
    whole = refs.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ref_idx", "text"))), lambda x: x["text"]).alias("refs"))
    state.update(cand.withColumnRenamed("text", "hyp").join(whole, "id"), 0)
    bags = state.compute(tfidf=True)["references"]
    total = F.aggregate(F.map_values("tfidf"), F.lit(0.0), lambda a, w: a + w)
    return bags.select("id", "ref_idx", "n", F.size("tfidf").alias("grams"), F.round(total, 6).alias("total"))


def wer_streamed(spark, sf_dir):
    """Error rates after a stream, by task; a batch adds to the running sums."""
    pairs = bench_pairs(spark, sf_dir).withColumn("task", F.when(F.col("id") % 3 == 0, "asr").otherwise("aac"))
    at = shared.fresh_folder(spark)
    rates = running_errors.running_rate(running.in_batches(spark, pairs, f"{at}/input", _BATCHES), "task", tokenize=tokens.words)
    keep = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{at}/rates")
    running.done(rates.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start())
    return spark.read.parquet(f"{at}/rates").select("task", "distance", "ref_length", F.round("wer", 6).alias("wer"))


def efficiency_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") - 1).alias("it"), (F.abs("value") * 1e9).cast("long").alias("memory"), (F.col("value") / 7).alias("ttft"), (F.col("value") / 100).alias("tpot"))
    return measurements.summary(e, 10).select(*[F.round(c, 6).alias(c) for c in ("memory_gb", "inference_s", "ttft_s", "tpot_s")])


def batch_pad_mask(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, (F.col("vec_id") % 5 + 1).cast("int")).alias("values"))
    out = batching.padded(batching.in_batches(e, "vec_id"), "values")
    true = F.size(F.filter("padding_mask", lambda x: x))
    return out.select("vec_id", "batch_id", F.size("values").alias("width"), true.alias("padded"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def array_preparation(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    frames = F.transform("v", lambda x: F.array(x, -x))
    out = e.select("vec_id", batching.at_most(batching.at_least(batching.first_channel(frames), 70), 68).alias("p"), batching.argmax(F.col("v")).alias("best"))
    return out.select("vec_id", F.size("p").alias("size"), F.round(F.get("p", 3), 6).alias("fourth"), F.get("p", 66).alias("filled"), "best")


QUERIES = [ngram_counts, doc_freq, tfidf_weights, tfidf_norms, ciderd_sentence, ciderd_corpus, spider_score, task_scores, ciderd_multi_ref, ciderd_streamed, ciderd_streamed_corpus, ciderd_tfidf, wer_streamed, efficiency_summary, batch_pad_mask, array_preparation]

_TOKS = "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')"
_MULTI_C = """select conv_id as id, arg_max(text, turn) as text from conversations where role = 'assistant' and conv_id in (select conv_id from conversations where role = 'user') group by 1"""
_MULTI_R = """select conv_id as id, turn as ref_idx, text from conversations where role = 'user' and conv_id in (select conv_id from conversations where role = 'assistant')"""


def _grams(source: str, keys: str) -> str:
    return f"""select {keys}, n, gram, count(*) as tf from (
      select {keys}, n, array_to_string(list_slice(t, i, i + n - 1), ' ') as gram from (
        select {keys}, t, n, unnest(generate_series(1, len(t) - n + 1)) as i from (select {keys}, {_TOKS} as t from ({source})), (select unnest([1, 2, 3, 4]) as n) where len(t) >= n))
      group by all"""


def _cider(cand: str, refs: str) -> str:
    return f"""
with c as ({_grams(cand, 'id')}), r as ({_grams(refs, 'id, ref_idx')}),
big as (select count(distinct id)::double as big from ({refs})),
df as (select gram, n, count(distinct id) as df from r group by 1, 2),
wc as (select c.*, tf * (ln(big) - ln(greatest(1, coalesce(df, 0)))) as w from c left join df using (gram, n), big),
wr as (select r.*, tf * (ln(big) - ln(greatest(1, coalesce(df, 0)))) as w from r left join df using (gram, n), big),
nc as (select id, n, sqrt(sum(w * w)) as nc from wc group by 1, 2), nr as (select id, ref_idx, n, sqrt(sum(w * w)) as nr from wr group by 1, 2, 3),
lc as (select id, greatest(len({_TOKS}) - 1, 0) as lc from ({cand})), lr as (select id, ref_idx, greatest(len({_TOKS}) - 1, 0) as lr from ({refs})),
dot as (select wc.id, wr.ref_idx, wc.n, sum(least(wc.w, wr.w) * wr.w) as dot from wc join wr on wc.id = wr.id and wc.gram = wr.gram and wc.n = wr.n group by 1, 2, 3),
sim as (select id, sum(case when nc * nr <> 0 then dot / (nc * nr) else dot end * exp(-pow(lc - lr, 2) / 72.0)) as sim
  from dot join nc using (id, n) join nr using (id, ref_idx, n) join lc using (id) join lr using (id, ref_idx) group by 1),
each as (select id, count(*) as refs from ({refs}) group by 1)
select id, 10.0 * coalesce(sim, 0) / 4 / refs as cider_d from ({cand}) join each using (id) left join sim using (id)"""


def oracles() -> dict[str, str]:
    cand, refs = f"select id, hyp as text from ({_BENCH})", f"select id, 0 as ref_idx, ref as text from ({_BENCH})"
    single, weights = _cider(cand, refs), f"""
      with r as ({_grams(_MULTI_R, 'id, ref_idx')}), df as (select gram, n, count(distinct id) as df from r group by 1, 2), big as (select count(distinct id)::double as big from ({_MULTI_R}))
      select id, ref_idx, n, gram, tf * (ln(big) - ln(df)) as w from r join df using (gram, n), big"""
    asr, aac = f"select * from ({_BENCH}) where id % 9 <> 4 and id % 3 = 0", f"select * from ({_BENCH}) where id % 9 <> 4 and id % 3 <> 0"
    captions = _cider(f"select id, hyp as text from ({aac})", f"select id, 0 as ref_idx, ref as text from ({aac})")
    return {
        "task_scores": f"""select 'asr' as task, 'WER' as metric, round(sum(distance) / sum(ref_length), 4) as score from ({_sql_errors(asr, _sql_words)})
          union all select 'aac', 'SPIDEr', round(avg(cider_d) * 100, 4) from ({captions})""",
        "ngram_counts": f"select id, n::int as n, gram, tf from ({_grams('select item_id as id, text from benchmark', 'id')})",
        "doc_freq": f"select gram, count(distinct id) as df from ({_grams(_MULTI_R, 'id, ref_idx')}) group by n, gram",
        "tfidf_weights": f"select id, ref_idx, n::int as n, gram, round(w, 6) as w from ({weights})",
        "tfidf_norms": f"select id, ref_idx, n::int as n, round(sqrt(sum(w * w)), 6) as norm from ({weights}) group by 1, 2, 3",
        "ciderd_sentence": f"select id, round(cider_d, 6) as cider_d from ({single})",
        "ciderd_corpus": f"select round(avg(cider_d), 6) as cider_d from ({single})",
        "spider_score": f"select round(avg(cider_d) * 100, 4) as spider from ({single})",
        "ciderd_multi_ref": f"select id, round(cider_d, 6) as cider_d from ({_cider(_MULTI_C, _MULTI_R)})",
        "ciderd_streamed": f"select id, round(cider_d, 6) as cider_d from ({_cider(_MULTI_C, _MULTI_R)})",
        "ciderd_streamed_corpus": f"select round(avg(cider_d), 6) as cider_d from ({single})",
        "ciderd_tfidf": f"""select id, (dense_rank() over (partition by id order by turn) - 1)::int as ref_idx, n, grams, total from (
          select id, ref_idx as turn, n::int as n, count(*)::int as grams, round(sum(w), 6) as total from ({weights}) group by all)""",
        "wer_streamed": text_queries.oracles()["wer_by_task"],
        "efficiency_summary": """select round(avg(trunc(abs(value) * 1e9)::bigint / 1073741824), 6) as memory_gb, round(avg(value / 7 + value / 100), 6) as inference_s,
          round(avg(value / 7), 6) as ttft_s, round(avg(value / 100), 6) as tpot_s from events where event_id - 1 >= 10""",
        "batch_pad_mask": """with e as (select vec_id, list_slice(embedding::double[], 1, vec_id % 5 + 1) as v, ((row_number() over (order by vec_id)) - 1) // 8 as batch_id from embeddings)
          select vec_id, batch_id::bigint as batch_id, (max(len(v)) over (partition by batch_id))::int as width, (max(len(v)) over (partition by batch_id) - len(v))::int as padded, round(list_sum(v), 6) as total from e""",
        "array_preparation": """select vec_id, 68::int as size, round(embedding[4]::double, 6) as fourth, 0.0::double as filled,
          (list_position(embedding::double[], list_max(embedding::double[])) - 1)::bigint as best from embeddings""",
    }

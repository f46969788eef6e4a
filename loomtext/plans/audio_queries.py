"""Queries of audio files, resampling, spectrograms and measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import audio as signals
from ..operators import batching, measurements
from ..sources import annotations, audio, settings, shared
from .text_queries import table

#: Vectors that one file holds, and the formats that files take in turn; one in seven is cut off in its head.
_PER_FILE = 64
_KINDS = ["pcm16", "pcm8", "pcm24", "float32", "stereo"]


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def _clips(spark, sf_dir):
    """Samples of 64 vectors each, as one signal."""
    v = _vectors(spark, sf_dir).withColumn("clip", F.floor(F.col("vec_id") / _PER_FILE))
    return v.groupBy("clip").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "v"))), lambda x: x["v"])).alias("signal"))


def _read_back(spark, sf_dir):
    """Files of all formats, written and read back, by position; those that can't be read get the first one's samples."""
    clips = _clips(spark, sf_dir)
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), (F.col("clip") % len(_KINDS)).cast("int"))
    frames = F.transform("signal", lambda x: F.when(kind == "stereo", F.array(x, -x)).otherwise(F.array(x)))
    content = audio.as_wav(frames, F.when(kind == "stereo", "pcm16").otherwise(kind))
    made = clips.select("clip", content.alias("content")).select("clip", F.when(F.col("clip") % 7 == 3, F.substring("content", 1, 20)).otherwise(F.col("content")).alias("content"))
    at = shared.fresh_folder(spark)
    audio.write_files(made, at, "clip")
    read = audio.read_audio(spark, at).withColumn("path", F.substring_index("path", "/", 1))
    items = clips.select(F.col("clip").alias("position"), F.concat(F.lit("clip="), "clip").alias("path"))
    return annotations.with_audio(items, read.select("path", "samples", "rate"))


def audio_files(spark, sf_dir):
    out = _read_back(spark, sf_dir)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return out.select(F.col("position").alias("clip"), "rate", F.size("samples").alias("n"), F.round(total, 6).alias("total"), F.round(F.get("samples", 100), 9).alias("one"))


_LEAST, _MOST, _TARGET = 2000, 1800, 8000


def audio_batches(spark, sf_dir):
    """From files to batches: filled to a least length, resampled, cut to a greatest one, a spectrogram, and padding with its mask."""
    read = _read_back(spark, sf_dir).select("position", "rate", batching.at_least(F.col("samples"), _LEAST).alias("samples"))
    read = read.withColumn("samples", batching.at_most(signals.resampled(F.col("samples"), F.col("rate"), _TARGET), _MOST))
    read = read.withColumn("mel", signals.spectrogram(F.col("samples"), _TARGET, 64, 32, 10, None))
    out = batching.padded(batching.in_batches(read, "position", 4), "samples")
    masked = F.size(F.filter("padding_mask", lambda x: x))
    return out.select(F.col("position").alias("clip"), "batch_id", F.size("samples").alias("width"), masked.alias("padded"), F.col("mel.mels").alias("mels"), F.col("mel.frames").alias("frames"))


_UP, _DOWN, _CROSSINGS = 3, 2, 4


def resampled_vectors(spark, sf_dir):
    """Every vector as a signal at three halves of its rate."""
    out = _vectors(spark, sf_dir).select("vec_id", signals.resampled(F.col("v"), _DOWN, _UP, _CROSSINGS).alias("y"))
    energy = F.aggregate("y", F.lit(0.0), lambda a, x: a + x * x)
    return out.select("vec_id", F.size("y").alias("n"), F.round(energy, 6).alias("energy"), *[F.round(F.get("y", k), 6).alias(f"y{k}") for k in (0, 1, 50, 95)])


_RATE, _SIZE, _HOP, _MELS = 8000, 16, 4, 5


def log_mel_vectors(spark, sf_dir):
    """The log-mel spectrogram of every vector as a short signal."""
    out = _vectors(spark, sf_dir).select("vec_id", signals.spectrogram(F.col("v"), _RATE, _SIZE, _HOP, _MELS, None).alias("s")).select("vec_id", "s.*")
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    at = lambda m, f: F.round(F.get("values", F.lit(m) * F.col("frames") + f), 5)
    return out.select("vec_id", "mels", "frames", F.round(total, 4).alias("total"), F.round(F.array_max("values"), 5).alias("top"), at(0, 0).alias("first"), at(4, 7).alias("high"))


def batch_numbers(spark, sf_dir):
    """Every document's batch and place in it, in order of id."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return batching.in_batches(d, "doc_id", 32, "place").select("doc_id", "batch_id", "place")


def measured_runs(spark, sf_dir):
    """Counts and sums that were observed while queries ran, of each of several iterations; each took some time."""
    lines = table(spark, sf_dir, "orders").select("o_orderkey")
    runs = [lines.where(F.col("o_orderkey") % 5 == k) for k in range(5)]
    seen = measurements.observed(runs, {"rows": F.count(F.lit(1)), "keys": F.sum("o_orderkey")})
    return seen.select("it", "rows", "keys", (F.col("seconds") > 0).alias("timed"))


def annotation_scan(spark, sf_dir):
    """Annotation documents, written from the turns, a file for each ten conversations, and read with defaults and a prefix."""
    t = table(spark, sf_dir, "conversations").where("text is not null")
    item = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("testset_id"), F.concat(F.lit("wav/"), "conv_id", F.lit("/"), "turn", F.lit(".wav")).alias("path"),
        F.when(F.col("turn") % 2 == 0, "aac").alias("task"), "text", F.when(F.col("turn") % 3 == 0, F.col("role")).alias("Q"),
    )
    whole = t.groupBy(F.floor(F.col("conv_id") / 10).alias("file")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("annotation"))).alias("content"))
    at = shared.fresh_folder(spark)
    audio.write_files(whole, at, "file")
    read = annotations.read_annotations(spark, f"{at}/*", prefix="/data")
    return read.select("testset_id", "path", "task", F.col("Q").alias("question"), "text")


def settings_merged(spark, sf_dir):
    """Settings of nations, with those of their vendors as overrides in order of id: the last one counts."""
    base = table(spark, sf_dir, "nation").select(F.explode(F.array(
        F.struct(F.concat(F.lit("nation."), "n_nationkey", F.lit(".name")).alias("path"), F.lit("text").alias("kind"), F.col("n_name").alias("value")),
        F.struct(F.concat(F.lit("nation."), "n_nationkey", F.lit(".region")).alias("path"), F.lit("integer").alias("kind"), F.col("n_regionkey").cast("string").alias("value")),
    )).alias("s"), F.lit(0).alias("position")).select("s.*", "position")
    given = table(spark, sf_dir, "vendors").where("nation_id is not null and name is not null").select(F.concat(F.lit("nation."), "nation_id", F.lit(".name")).alias("path"), F.lit("text").alias("kind"), F.col("name").alias("value"), F.col("vendor_id").alias("position"))
    return settings.merged(base, given)


QUERIES = [annotation_scan, settings_merged, audio_files, audio_batches, resampled_vectors, log_mel_vectors, batch_numbers, measured_runs]


def oracles() -> dict[str, str]:
    def level(top: int, full: int) -> str:
        return f"floor(x * {top} + 0.5) / {full}.0"

    read = f"case clip % 5 when 1 then {level(127, 128)} when 2 then {level((1 << 23) - 1, 1 << 23)} when 3 then x else {level(32767, 32768)} end"
    t = f"(m * {_DOWN} - k * {_UP})"
    wide = max(_UP, _DOWN)
    tap = f"({_UP}.0 / {wide} * case when {t} = 0 then 1.0 else sin(pi() * {t} / {wide}) / (pi() * {t} / {wide}) end * (0.5 + 0.5 * cos(pi() * {t} / {_CROSSINGS * wide})))"
    mel = "case when f < 1000 then 3 * f / 200 else 15 + ln(f / 1000) * 27 / ln(6.4) end"
    back = "case when m < 15 then 200 * m / 3 else 1000 * exp((m - 15) * ln(6.4) / 27) end"
    return {
        "audio_files": f"""
with v as (select vec_id // {_PER_FILE} as clip, vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding::double[]) as x from embeddings),
r as (select clip, {read} as x, row_number() over (partition by clip order by vec_id, i) as i from v),
s as (select clip, count(*) as n, round(sum(x), 6) as total, round(max(case when i = 101 then x end), 9) as one from r group by 1)
select a.clip::bigint as clip, 16000 as rate, b.n::int as n, b.total, b.one from s a join s b on b.clip = case when a.clip % 7 = 3 then (select min(clip) from s) else a.clip end""",
        "audio_batches": f"""
with c as (select vec_id // {_PER_FILE} as clip, sum(len(embedding)) as n from embeddings group by 1),
s as (select a.clip, least(ceil(greatest(b.n, {_LEAST}) * {_TARGET} / 16000.0), {_MOST})::int as n, (row_number() over (order by a.clip) - 1) // 4 as batch_id
  from c a join c b on b.clip = case when a.clip % 7 = 3 then (select min(clip) from c) else a.clip end)
select clip::bigint as clip, batch_id::bigint as batch_id, (max(n) over (partition by batch_id))::int as width, (max(n) over (partition by batch_id) - n)::int as padded, 10 as mels, (n // 32)::int as frames from s""",
        "resampled_vectors": f"""
with e as (select vec_id, embedding::double[] as v, len(embedding) as n from embeddings),
y as (select vec_id, list_transform(range(0, ceil(n * {_UP} / {_DOWN}.0)::bigint), lambda m: list_sum(list_transform(range(0, n), lambda k: case when abs{t} <= {_CROSSINGS * wide} then v[k + 1] * {tap} else 0.0 end))) as y from e)
select vec_id, len(y)::int as n, round(list_sum(list_transform(y, lambda x: x * x)), 6) as energy, {', '.join(f'round(y[{k + 1}], 6) as y{k}' for k in (0, 1, 50, 95))} from y""",
        "log_mel_vectors": f"""
with edges as (select i, {back} as hz from (select i, i * ({mel.replace('f', f'{_RATE / 2}')}) / {_MELS + 1} as m from range(0, {_MELS + 2}) t(i))),
filters as (select a.i as mel, k, greatest(0, least((k * {_RATE / _SIZE} - a.hz) / (b.hz - a.hz), (c.hz - k * {_RATE / _SIZE}) / (c.hz - b.hz))) * 2 / (c.hz - a.hz) as weight
  from edges a join edges b on b.i = a.i + 1 join edges c on c.i = a.i + 2, range(0, {_SIZE // 2 + 1}) u(k)),
e as (select vec_id, embedding::double[] as v, len(embedding) as n from embeddings),
x as (select vec_id, f, t, v[1 + case when f * {_HOP} + t < {_SIZE // 2} then {_SIZE // 2} - f * {_HOP} - t when f * {_HOP} + t - {_SIZE // 2} >= n then 2 * n - 2 - (f * {_HOP} + t - {_SIZE // 2}) else f * {_HOP} + t - {_SIZE // 2} end]
    * (0.5 - 0.5 * cos(2 * pi() * t / {_SIZE})) as x from e, range(0, 1000) g(f), range(0, {_SIZE}) h(t) where f < n // {_HOP}),
p as (select vec_id, f, k, pow(sum(x * cos(2 * pi() * k * t / {_SIZE})), 2) + pow(sum(x * sin(2 * pi() * k * t / {_SIZE})), 2) as power from x, range(0, {_SIZE // 2 + 1}) u(k) group by 1, 2, 3),
l as (select vec_id, mel, f, log10(greatest(sum(weight * power), 1e-10)) as v from p join filters using (k) group by 1, 2, 3),
z as (select vec_id, mel, f, (greatest(v, max(v) over (partition by vec_id) - 8) + 4) / 4 as v from l)
select vec_id, {_MELS} as mels, (max(f) + 1)::int as frames, round(sum(v), 4) as total, round(max(v), 5) as top, round(max(case when mel = 0 and f = 0 then v end), 5) as first,
  round(max(case when mel = 4 and f = 7 then v end), 5) as high from z group by 1""",
        "annotation_scan": """select conv_id || '-' || turn as testset_id, '/data/wav/' || conv_id || '/' || turn || '.wav' as path, case when turn % 2 = 0 then 'aac' else 'asr' end as task,
          coalesce(case when turn % 3 = 0 then role end, '') as question, text from conversations where text is not null""",
        "settings_merged": """with v as (select 'nation.' || nation_id || '.name' as path, arg_max(name, vendor_id) as name from vendors where nation_id is not null and name is not null group by 1),
          b as (select 'nation.' || n_nationkey || '.name' as path, n_name as name from nation)
          select path, 'text' as kind, coalesce(v.name, b.name) as value from b full join v using (path)
          union all select 'nation.' || n_nationkey || '.region', 'integer', n_regionkey::varchar from nation""",
        "batch_numbers": "select doc_id, ((row_number() over (order by doc_id) - 1) // 32)::bigint as batch_id, ((row_number() over (order by doc_id) - 1) % 32)::int as place from documents",
        "measured_runs": "select (o_orderkey % 5)::int as it, count(*) as rows, sum(o_orderkey)::bigint as keys, true as timed from orders group by 1, 4",
    }

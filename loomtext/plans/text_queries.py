"""Queries of normalization, tokens and word errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize, numbers, tokens
from ..operators import word_errors
from ..operators.edit_distance import token_distance
from ..sources import annotations, shared, submission
from . import number_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def bench_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text as a reference for the next one."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    nxt = b.select((F.col("item_id") - 1).alias("id"), F.col("text").alias("hyp"))
    return b.join(nxt, b.item_id == nxt.id).select("id", "hyp", F.col("text").alias("ref"))


def conv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns(spark, sf_dir).withColumn("next_role", F.lead("role").over(w)).withColumn("hyp", F.lead("text").over(w))
    t = t.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", "hyp", F.col("text").alias("ref"))
    return t


def text_lower_brackets(spark, sf_dir):
    t = F.concat(F.lit("[Noise] "), F.col("text"), F.lit(" (uh) <x>"))
    return turns(spark, sf_dir).select("conv_id", "turn", normalize.replaced(F.lower(t), normalize.BRACKETS).alias("cleaned"))


def text_fillers(spark, sf_dir):
    t = F.concat(F.lit("uh "), F.lower("text"), F.lit(" mhm it 's"))
    return turns(spark, sf_dir).select("conv_id", "turn", normalize.replaced(t, normalize.FILLERS).alias("cleaned"))


def text_contractions(spark, sf_dir):
    t = F.concat(F.lower("text"), F.lit(" mr x won't; she'd been st john's we'll can't"))
    return turns(spark, sf_dir).select("conv_id", "turn", normalize.replaced(t, normalize.FULL_FORMS).alias("expanded"))


def strip_symbols_diacritics(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", normalize.plain_symbols(F.lower("text"), normalize.KEPT_SIGNS).alias("plain"))


#: Number words of a turn: so many, picked from the lexicon by its ids.
_PICKED = 7


def _number_words(turns_: DataFrame) -> DataFrame:
    """Turns with ``phrase``: words of numbers, signs, currencies and numerals in any order, by the ids of the turn."""
    known = F.array(*[F.lit(w) for w in _SPOKEN])
    seed = F.col("conv_id") * 31 + F.col("turn") * 17
    picked = [F.get(known, F.pmod(seed * (2 * k + 1) + k * k * 7, F.lit(len(_SPOKEN))).cast("int")) for k in range(1, _PICKED + 1)]
    return turns_.withColumn("phrase", F.concat_ws(" ", *picked))


#: Small powers stand here alone, as SQL's integers end at 10^38.
_SPOKEN = sorted(w for w in numbers.LEXICON if not any(w.startswith(p) for p in numbers.POWERS[2:])) + ["and a half", "12", "0.05", "$20", "-5", "¢7", "1st", "cup"]


def spoken_numbers(spark, sf_dir):
    """The number stage alone, over every turn's number words."""
    return _number_words(turns(spark, sf_dir)).select("conv_id", "turn", "phrase", numbers.standardized(F.col("phrase")).alias("standard"))


def normalize_spoken(spark, sf_dir):
    """The whole normalization of every turn with its number words behind it."""
    t = _number_words(turns(spark, sf_dir)).withColumn("text", F.concat("text", F.lit(" "), "phrase"))
    return normalize.with_normalized(t, "text", "normalized").select("conv_id", "turn", "normalized")


def _in_words(n):
    """A whole number from 1 to 999,999 as it is spoken."""
    ones, tens = F.array(*[F.lit(w) for w in ["", *numbers.UNITS]]), F.array(*[F.lit(w) for w in ["", "", *numbers.TENS]])
    whole = lambda a, b: F.floor(a / b).cast("int")
    shown = lambda w: F.when(w != "", w)

    def below(k):  # 1,000
        rest, hundreds = k % 100, whole(k, 100)
        small = F.when(rest < 20, shown(F.get(ones, rest))).otherwise(F.concat_ws(" ", F.get(tens, whole(rest, 10)), shown(F.get(ones, rest % 10))))
        return F.concat_ws(" ", F.when(hundreds > 0, F.concat(F.get(ones, hundreds), F.lit(" hundred"))), small)

    thousands = whole(n, 1000)
    return F.concat_ws(" ", F.when(thousands > 0, F.concat(below(thousands), F.lit(" thousand"))), shown(below(n % 1000)))


def _spoken_prices(spark, sf_dir):
    """Orders with their price spoken and written; in one of five a dollar too much is said. Cents go by the key."""
    # a file of one row group is one task, whatever is worked out of its rows
    orders = table(spark, sf_dir, "orders").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "o_orderkey").select("o_orderkey", "o_orderstatus", (F.floor("o_totalprice") + 1).cast("int").alias("dollars"), (F.col("o_orderkey") % 98 + 2).cast("int").alias("cents"))
    said = F.col("dollars") + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)
    spoken = F.concat(F.lit("pay "), _in_words(said), F.lit(" dollars and "), _in_words(F.col("cents")), F.lit(" cents now"))
    written = F.concat(F.lit("Pay $"), "dollars", F.lit("."), F.lpad(F.col("cents").cast("string"), 2, "0"), F.lit(" now!"))
    return normalize.once(normalize.once(orders, spoken, "hyp"), written, "ref")


def spoken_amounts(spark, sf_dir):
    return _spoken_prices(spark, sf_dir).select("o_orderkey", numbers.standardized(F.col("hyp")).alias("standard"))


def wer_spoken_amounts(spark, sf_dir):
    """Error rates of spoken against written amounts, by status."""
    errors = word_errors.pair_errors(_spoken_prices(spark, sf_dir))
    return word_errors.corpus_rate(errors, "o_orderstatus").select("o_orderstatus", "distance", "ref_length", F.round("wer", 6).alias("wer"))


def _values(rows: list[tuple], names: str) -> str:
    quote = lambda x: str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"(values {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) as v({names})"


SPELLING = [("the", "THE"), ("of", "OF"), ("und", "UND")]


def spelling_normalize(spark, sf_dir):
    table_ = spark.createDataFrame(SPELLING, "src string, dst string")
    return normalize.plain_spelling(turns(spark, sf_dir), "text", table_, "spelled").select("conv_id", "turn", "spelled")


def tokenize_13a(spark, sf_dir):
    t = F.concat("text", F.lit(" &quot;$20&quot; 5% x-1 a,b 1-2 3.5"))
    return turns(spark, sf_dir).select("conv_id", "turn", tokens.tokenized(t, "13a").alias("tokenized"))


def tokenize_intl(spark, sf_dir):
    t = F.concat("text", F.lit(" &quot;$20&quot; 5% x-1 a,b 1-2 3.5 -7 €3 <skipped>a+b"))
    return turns(spark, sf_dir).select("conv_id", "turn", tokens.tokenized(t, "intl").alias("tokenized"))


def tokenize_zh(spark, sf_dir):
    t = F.concat("text", F.lit(" 中文字，x中1。 a,b 3.5"))
    return turns(spark, sf_dir).select("conv_id", "turn", tokens.tokenized(t, "zh", lowercase=True).alias("tokenized"))


def punct_removal(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", tokens.tokenized(F.concat("text", F.lit(" . ?! a")), "none", without_punctuation=True).alias("tokenized"))


def token_edit_distance(spark, sf_dir):
    p = bench_pairs(spark, sf_dir)
    return p.select("id", token_distance(tokens.words(F.col("ref")), tokens.words(F.col("hyp"))).alias("distance"))


def aligned_pairs(spark, sf_dir):
    """Hypotheses and references from two tables, by key."""
    p = bench_pairs(spark, sf_dir)
    return word_errors.paired(p.select("id", "hyp"), p.select("id", "ref"), "id")


def _raw_bench(spark, sf_dir):
    return word_errors.pair_errors(bench_pairs(spark, sf_dir), tokens.words)


def wer_raw_by_pair(spark, sf_dir):
    return _raw_bench(spark, sf_dir).select("id", "distance", "ref_length", F.round(F.col("distance") / F.col("ref_length"), 6).alias("wer"))


def wer_raw_corpus(spark, sf_dir):
    return word_errors.corpus_rate(_raw_bench(spark, sf_dir)).select("distance", F.col("ref_length").cast("long").alias("ref_length"), F.round("wer", 6).alias("wer"))


def wer_by_task(spark, sf_dir):
    """Rates by group: the benchmark pairs by a task that depends on their id."""
    e = _raw_bench(spark, sf_dir).withColumn("task", F.when(F.col("id") % 3 == 0, "asr").otherwise("aac"))
    return word_errors.corpus_rate(e, "task").select("task", "distance", "ref_length", F.round("wer", 6).alias("wer"))


def hyp_truncate_eos(spark, sf_dir):
    t = F.concat("text", F.lit("<|end_of_text|>junk<|end_of_text|>"))
    return turns(spark, sf_dir).select("conv_id", "turn", annotations.hypothesis(F.when(F.col("turn") % 2 == 0, t).otherwise(F.col("text"))).alias("hyp"))


PROMPTS = [("user", "Repeat this."), ("assistant", "Answer this."), ("system", "Obey this.")]


def prompt_join(spark, sf_dir):
    p = spark.createDataFrame(PROMPTS, "task string, prompt string")
    t = turns(spark, sf_dir).where(F.col("role").isin([a for a, _ in PROMPTS]))
    return annotations.prompted(t.withColumnRenamed("role", "task"), p).select("conv_id", "turn", "prompt")


def _submission(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.format_string("test%04d", "item_id").alias("testset_id"), "text")


def submission_validate_ok(spark, sf_dir):
    return submission.verdict(_submission(spark, sf_dir), ["testset_id", "text"])


def submission_validate_ids(spark, sf_dir):
    return submission.verdict(_submission(spark, sf_dir).withColumn("testset_id", F.replace("testset_id", F.lit("test0001"), F.lit("test1"))), ["testset_id", "text"])


def submission_validate_text(spark, sf_dir):
    return submission.verdict(_submission(spark, sf_dir).withColumn("text", F.when(F.col("testset_id") == "test0002", "NA").otherwise(F.col("text"))), ["testset_id", "text"])


def submission_validate_columns(spark, sf_dir):
    return submission.verdict(_submission(spark, sf_dir), ["text", "testset_id"])


def submission_csv_files(spark, sf_dir):
    """What is said of CSV files that are written first: a good one, and one for each rule that it can break."""
    good = _submission(spark, sf_dir)
    bad_id = good.withColumn("testset_id", F.replace("testset_id", F.lit("test0001"), F.lit("test1")))
    bad_text = good.withColumn("text", F.when(F.col("testset_id") == "test0002", "NA").otherwise(F.col("text")))
    at = shared.fresh_folder(spark)
    for name, rows in (("good", good), ("bad_id", bad_id), ("bad_text", bad_text)):
        submission.write(rows, f"{at}/{name}")
    good.select("text", "testset_id").write.option("header", True).option("escape", '"').csv(f"{at}/columns")
    said = [(name, submission.validate(spark, f"{at}/{name}")) for name in ("good", "bad_id", "bad_text", "columns", "missing")]
    return spark.createDataFrame(said, "file string, message string")


def annotation_defaults(spark, sf_dir):
    t = turns(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("testset_id"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("task"), F.when(F.col("turn") % 3 == 0, F.col("text")).alias("Q"))
    return annotations.with_defaults(t).withColumnRenamed("Q", "question")


def tokenize_chars(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", tokens.tokenized(F.col("text"), "none", characters=True, lowercase=True).alias("tokenized"))


def wer_raw_conversations(spark, sf_dir):
    return word_errors.pair_errors(conv_pairs(spark, sf_dir), tokens.words).select("conv_id", "turn", "distance", "ref_length")


def normalize_text(spark, sf_dir):
    return normalize.with_normalized(turns(spark, sf_dir), "text", "normalized").select("conv_id", "turn", "normalized")


def wer_by_pair(spark, sf_dir):
    return word_errors.pair_errors(bench_pairs(spark, sf_dir)).select("id", "distance", "ref_length")


def wer_corpus(spark, sf_dir):
    return word_errors.corpus_rate(word_errors.pair_errors(bench_pairs(spark, sf_dir))).select("distance", "ref_length", F.round("wer", 6).alias("wer"))


def normalize_benchmark(spark, sf_dir):
    return normalize.with_normalized(table(spark, sf_dir, "benchmark"), "text", "normalized").select("item_id", "normalized")


QUERIES = [
    text_lower_brackets, text_fillers, text_contractions, strip_symbols_diacritics, spoken_numbers, spoken_amounts, spelling_normalize, tokenize_13a,
    tokenize_intl, tokenize_zh, tokenize_chars, punct_removal, token_edit_distance, aligned_pairs, wer_raw_by_pair, wer_raw_corpus, wer_by_task,
    wer_spoken_amounts, hyp_truncate_eos, prompt_join, submission_validate_ok, submission_validate_ids, submission_validate_text, submission_validate_columns,
    submission_csv_files, annotation_defaults, wer_raw_conversations, normalize_text, normalize_spoken, normalize_benchmark, wer_by_pair, wer_corpus,
]


#: RE2 knows word boundaries of ASCII alone, so other letters are spelled out for it meanwhile.
_LETTERS = "éßçêèüöíóäñáàâîïôùûëúì"


def _sql_words_bound(expr: str, pairs: list[tuple[str, str]]) -> str:
    for k, c in enumerate(_LETTERS):
        expr = f"replace({expr}, '{c}', 'zqx{chr(97 + k)}xqz')"
    expr = number_sql.regexp(expr, pairs)
    for k, c in enumerate(_LETTERS):
        expr = f"replace({expr}, 'zqx{chr(97 + k)}xqz', '{c}')"
    return expr


_SIGNS = r"[\p{M}\p{S}\p{P}]"


def _sql_plain(expr: str) -> str:
    plain = f"replace(strip_accents({expr}), 'ß', 'ss')"
    # RE2 has no intersection of classes: kept signs are taken out of the way and put back
    for k, c in enumerate(normalize.KEPT_SIGNS):
        plain = f"replace({plain}, '{c}', chr({0xE000 + k}))"
    plain = f"regexp_replace({plain}, '{_SIGNS}', ' ', 'g')"
    for k, c in enumerate(normalize.KEPT_SIGNS):
        plain = f"replace({plain}, chr({0xE000 + k}), '{c}')"
    return plain


def _sql_words(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, '\\s+'), lambda x: x <> '')"


def _sql_before(expr: str) -> str:
    return _sql_plain(number_sql.regexp(_sql_words_bound(number_sql.regexp(f"lower({expr})", normalize.BRACKETS), [*normalize.FILLERS, *normalize.FULL_FORMS]), normalize.STOPS))


def _sql_normalized(source: str, *columns: str) -> str:
    """A query: ``source`` with its columns normalized in place, number words and all."""
    out = source
    for c in columns:
        read = number_sql.standardized(f"select * exclude ({c}), {_sql_before(c)} as {c}__ from ({out})", f"{c}__", f"{c}__n")
        out = f"select * exclude ({c}__, {c}__n), {number_sql.regexp(f"array_to_string({_sql_words(f'{c}__n')}, ' ')", normalize.LONE_SIGNS)} as {c} from ({read})"
    return out


def _sql_unescaped(expr: str) -> str:
    e = f"replace(replace(replace({expr}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for a, b in tokens.ENTITIES:
        e = f"replace({e}, '{a}', '{b}')"
    return e


def _sql_13a(expr: str) -> str:
    e = number_sql.regexp(f"(' ' || {_sql_unescaped(expr)} || ' ')", tokens.RULES_13A)
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


def _sql_intl(expr: str) -> str:
    return f"trim(regexp_replace({number_sql.regexp(_sql_unescaped(expr), tokens.RULES_INTL)}, '\\s+', ' ', 'g'))"


def _sql_zh(expr: str) -> str:
    return _sql_13a(number_sql.regexp(expr, [("([\\p{Han}\u3000-\u303f\uff00-\uffef])", " $1 ")]))


def _sql_scoring(expr: str) -> str:
    return f"list_transform(list_filter(string_split({_sql_13a(expr)}, ' '), lambda x: not regexp_matches(x, '^\\p{{P}}*$')), lambda x: lower(x))"


def _sql_distance(r: str, h: str) -> str:
    """Tokens as characters, from arrays r and h and v, their distinct tokens."""
    code = lambda a: f"array_to_string(list_transform({a}, lambda x: chr(list_position(v, x)::int)), '')"
    return f"levenshtein({code(r)}, {code(h)})"


_BENCH = "select a.item_id as id, b.text as hyp, a.text as ref from benchmark a join benchmark b on b.item_id = a.item_id + 1"
_CONV = """select conv_id, turn, nxt as hyp, text as ref from (
  select *, lead(text) over (partition by conv_id order by turn) as nxt, lead(role) over (partition by conv_id order by turn) as nr from conversations)
  where role = 'user' and nr = 'assistant'"""


def _sql_errors(pairs: str, words, keep: str = "id") -> str:
    return f"""select {keep}, {_sql_distance('r', 'h')}::bigint as distance, len(r)::bigint as ref_length from (
      select *, list_distinct(r || h) as v from (select *, {words('ref')} as r, {words('hyp')} as h from ({pairs})))"""


def _sql_diagonals(pairs: str, key: str) -> str:
    """Edit distances of long pairs of arrays r and h: the table diagonal by diagonal, a list for each."""
    return f"""
with recursive p as materialized (select *, len(r) as n, len(h) as m from ({pairs})),
d as (
  select {key}, 0 as k, list_transform(range(0, n + 1), lambda i: case when i = 0 then 0 else 1000000000 end) as a, list_transform(range(0, n + 1), lambda i: 1000000000) as b from p
  union all
  select {key}, k + 1, list_transform(range(0, n + 1), lambda i: case when i > k + 1 or k + 1 - i > m then 1000000000 when i = 0 or i = k + 1 then k + 1
    else least(a[i] + 1, a[i + 1] + 1, b[i] + (r[i] <> h[k + 1 - i])::int) end), a from d join p using ({key}) where k < n + m)
select {key}, a[n + 1]::int as distance, n::int as ref_length from d join p using ({key}) where k = n + m"""


def _sql_number_words() -> str:
    known = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in _SPOKEN) + "]"
    at = lambda k: f"((conv_id * 31 + turn * 17) * {2 * k + 1} + {k * k * 7}) % {len(_SPOKEN)} + 1"
    return f"select conv_id, turn, text, concat_ws(' ', {', '.join(f'w[{at(k)}]' for k in range(1, _PICKED + 1))}) as phrase from conversations, (select {known} as w)"


def oracles() -> dict[str, str]:
    each = "select conv_id, turn, {} as {} from conversations"
    raw = _sql_errors(_BENCH, _sql_words)
    normal = _sql_errors(_sql_normalized(_BENCH, "hyp", "ref"), _sql_scoring)
    total = "sum(distance)::bigint as distance, sum(ref_length)::bigint as ref_length, round(sum(distance) / sum(ref_length), 6) as wer"
    quoted = lambda m: m.replace("'", "''")
    message = lambda m: f"select '{quoted(m)}' as message"
    sub = "select printf('test%04d', item_id) as testset_id, text from benchmark"
    check = f"""select case when not bool_and(regexp_full_match(testset_id, 'test\\d{{{{4}}}}')) then '{quoted(submission.BAD_IDS)}'
      when bool_or(text is null or text in ({', '.join("'" + x + "'" for x in submission.MISSING)})) or bool_and(try_cast(text as double) is not null) then '{quoted(submission.BAD_TEXT)}'
      else '{quoted(submission.PASSED)}' end as message from ({{}})"""
    spelled = f"select conv_id, turn, unnest({_sql_words('text')}) as w, generate_subscripts({_sql_words('text')}, 1) as pos from conversations"
    return {
        "text_lower_brackets": each.format(number_sql.regexp("lower('[Noise] ' || text || ' (uh) <x>')", normalize.BRACKETS), "cleaned"),
        "text_fillers": each.format(number_sql.regexp("'uh ' || lower(text) || ' mhm it ''s'", normalize.FILLERS), "cleaned"),
        "text_contractions": each.format(_sql_words_bound("(lower(text) || ' mr x won''t; she''d been st john''s we''ll can''t')", normalize.FULL_FORMS), "expanded"),
        "strip_symbols_diacritics": each.format(_sql_plain("lower(text)"), "plain"),
        "spoken_numbers": f"select conv_id, turn, phrase, standard from ({number_sql.standardized(_sql_number_words(), 'phrase', 'standard')})",
        "spoken_amounts": "select o_orderkey, 'pay $' || (floor(o_totalprice)::int + 1 + (o_orderkey % 5 = 0)::int) || '.' || lpad((o_orderkey % 98 + 2)::varchar, 2, '0') || ' now' as standard from orders",
        "wer_spoken_amounts": f"select o_orderstatus, {total} from (select o_orderstatus, (o_orderkey % 5 = 0)::int as distance, 4 as ref_length from orders) group by 1",
        "normalize_text": f"select conv_id, turn, text as normalized from ({_sql_normalized('select conv_id, turn, text from conversations', 'text')})",
        "normalize_spoken": f"select conv_id, turn, text as normalized from ({_sql_normalized(f"select conv_id, turn, text || ' ' || phrase as text from ({_sql_number_words()})", 'text')})",
        "normalize_benchmark": f"select item_id, text as normalized from ({_sql_normalized('select item_id, text from benchmark', 'text')})",
        "wer_by_pair": f"select id, distance::int as distance, ref_length::int as ref_length from ({normal})",
        "wer_corpus": f"select {total} from ({normal})",
        "wer_raw_conversations": _sql_diagonals(f"select conv_id, turn, {_sql_words('ref')} as r, {_sql_words('hyp')} as h from ({_CONV})", "conv_id, turn"),
        "spelling_normalize": f"""select conv_id, turn, coalesce(spelled, case when text is not null then '' end) as spelled from conversations left join (
            select conv_id, turn, string_agg(coalesce(dst, w), ' ' order by pos) as spelled from ({spelled}) left join {_values(SPELLING, 'src, dst')} on src = w group by 1, 2) using (conv_id, turn)""",
        "tokenize_13a": each.format(_sql_13a("(text || ' &quot;$20&quot; 5% x-1 a,b 1-2 3.5')"), "tokenized"),
        "tokenize_intl": each.format(_sql_intl("(text || ' &quot;$20&quot; 5% x-1 a,b 1-2 3.5 -7 €3 <skipped>a+b')"), "tokenized"),
        "tokenize_zh": each.format(f"lower({_sql_zh("(text || ' 中文字，x中1。 a,b 3.5')")})", "tokenized"),
        "aligned_pairs": _BENCH,
        "submission_csv_files": "select file, message from " + _values([("good", submission.PASSED), ("bad_id", submission.BAD_IDS), ("bad_text", submission.BAD_TEXT), ("columns", submission.BAD_COLUMNS), ("missing", submission.NOT_FOUND)], "file, message"),
        "tokenize_chars": each.format("lower(array_to_string(list_filter(string_split(replace(text, ' ', '▁'), ''), lambda x: x <> ''), ' '))", "tokenized"),
        "punct_removal": each.format("array_to_string(list_filter(string_split(text || ' . ?! a', ' '), lambda x: not regexp_matches(x, '^\\p{P}*$')), ' ')", "tokenized"),
        "token_edit_distance": f"select id, distance::int as distance from ({raw})",
        "wer_raw_by_pair": f"select id, distance::int as distance, ref_length::int as ref_length, round(distance / ref_length, 6) as wer from ({raw})",
        "wer_raw_corpus": f"select {total} from ({raw})",
        "wer_by_task": f"select case when id % 3 = 0 then 'asr' else 'aac' end as task, {total} from ({raw}) group by 1",
        "hyp_truncate_eos": each.format("lower(split_part(case when turn % 2 = 0 then text || '<|end_of_text|>junk<|end_of_text|>' else text end, '<|end_of_text|>', 1))", "hyp"),
        "prompt_join": f"select conv_id, turn, 'USER: ' || prompt || chr(10) || 'ASSISTANT:' as prompt from conversations join {_values(PROMPTS, 'task, prompt')} on task = role",
        "submission_validate_ok": check.format(sub),
        "submission_validate_ids": check.format(f"select replace(testset_id, 'test0001', 'test1') as testset_id, text from ({sub})"),
        "submission_validate_text": check.format(f"select testset_id, case when testset_id = 'test0002' then 'NA' else text end as text from ({sub})"),
        "submission_validate_columns": message(submission.BAD_COLUMNS),
        "annotation_defaults": "select conv_id || '-' || turn as testset_id, coalesce(case when turn % 2 = 0 then role end, 'asr') as task, coalesce(case when turn % 3 = 0 then text end, '') as question from conversations",
    }

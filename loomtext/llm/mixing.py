"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, one pass after another, up to ``REPEATS``
passes. A copy's virtual finish time is the source's words up to and with it, over the source's
target. Copies are served in order of finish time until the budget is spent. Targets sum to the
budget, so it is spent about when the virtual time is the share of the budget that is asked for; the
copy that a source is being served then is cut in two there, and the parts finish by themselves. So
each source meets its target to the word, and the order alone decides what is taken.

Scale: only ids and sizes are shuffled. Running totals are kept in two levels: within slots of the
shuffle hash (a third of all rows in one source still spreads over its slots) and, over the few sums
of slots, between them. The finish times are range-partitioned by equal steps of virtual time, which
hold equally many words whatever the sources are, and just the step in which the budget runs out is
sorted to the row; what is taken of a copy follows from where it stands to that row. All is
DataFrame functions, and the order depends on nothing but the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, need, partitions
from .quality import words

WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3


def targets(sizes: DataFrame, repeats: int = REPEATS, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target, quota).

    Sources by code point, null last, weigh 5, 2, 1 and so on in turn, and share the budget, which is
    the sum of all sizes. A target stops at ``repeats`` times its source; what is over goes to the
    others by weight, until none is above. One row a source: in order of size over weight, those that
    stop are the first ones, so two running sums tell the level at which the others share. ``quota`` is
    ``share`` of the target in whole words, rounded by largest remainder, so quotas sum to ``share`` of the
    budget. The list of sources (not of documents) is ordered in one task.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    out = sizes.withColumn("weight", F.get(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int")))
    out = out.withColumn("most", F.lit(repeats) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    order = [F.col("ratio"), F.col("source").isNull(), F.col("source").cast("binary")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(Window.partitionBy())
    out = out.withColumn("level", (budget - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after))
    # the level of the first source that needn't stop holds for all after it
    free = F.col("ratio") > F.col("level")
    out = out.withColumn("shared", F.first(F.when(free, F.col("level")), ignorenulls=True).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("most").cast("double"), F.coalesce("shared", F.lit(float("inf"))) * F.col("weight"))
    out = out.select("source", "source_size", "weight", target.alias("target"), F.col("most").alias("most_words"), F.floor(budget * F.lit(share)).cast("long").alias("budget"))
    due = F.col("target") * F.lit(share)
    out = out.withColumn("quota", F.floor(due).cast("long")).withColumn("over", due - F.floor(due))
    left = F.col("budget") - F.sum("quota").over(Window.partitionBy())
    nearest = Window.orderBy(F.desc("over"), F.col("source").isNull(), F.col("source").cast("binary"))
    more = ((F.row_number().over(nearest) <= left) & (F.col("quota") < F.col("most_words"))).cast("long")
    return out.select("source", "source_size", "weight", "target", (F.col("quota") + more).alias("quota"))


def queued(documents: DataFrame, size: str = "size", repeats: int = REPEATS, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0) -> DataFrame:
    """``row`` (every column of ``documents``), source, size, source_size, target and ``parts``.

    ``parts`` lists (pass, finish, words) of the copies of a document in its source's queue; a copy
    that is being served at the virtual time ``share`` is two parts. Equal rows are queued beside each
    other; null ids come by hash like others. Documents of size 0 and sources without words have none.
    """
    spark = documents.sparkSession
    inner = [F.col(f"`{c}`") for c in documents.columns]
    rows = documents.select(F.struct(*inner).alias("row"), F.col("source").cast("string").alias("source"), F.col(size).cast("long").alias("size"), F.col("doc_id").alias("id"))
    rows = rows.withColumn("key", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
    slots = 16 * partitions(spark)
    rows = rows.withColumn("slot", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * slots / (1 << 32)).cast("int"))
    sums = rows.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    whole = targets(sums.groupBy("source").agg(F.sum("slot_size").alias("source_size")), repeats, weights, share)
    earlier = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("earlier", F.coalesce(F.sum("slot_size").over(earlier), F.lit(0)))
    sums = sums.join(whole, sums["source"].eqNullSafe(whole["source"])).select(sums["source"].alias("s"), F.col("slot").alias("t"), "earlier", "source_size", "target", "quota")
    own = Window.partitionBy("source", "slot").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("through", F.sum("size").over(own))
    rows = rows.join(sums, rows["source"].eqNullSafe(sums["s"]) & (rows["slot"] == sums["t"]))
    rows = rows.withColumn("through", F.col("through") + F.col("earlier"))
    parts = []
    for k in range(repeats):
        finish = F.try_divide(k * F.col("source_size") + F.col("through"), F.col("target"))
        first = F.col("quota") - k * F.col("source_size") - F.col("through") + F.col("size")  # words up to the virtual time ``share``
        first = F.greatest(F.lit(0), F.least(F.col("size"), first)).cast("long")
        parts.append(F.struct(F.lit(k).alias("pass"), F.least(finish, F.lit(float(share))).alias("finish"), first.alias("words")))
        parts.append(F.struct(F.lit(k).alias("pass"), finish.alias("finish"), (F.col("size") - first).alias("words")))
    every = F.filter(F.array(*parts), lambda c: (c["words"] > 0) & (F.col("target") > 0))
    return rows.select("row", "source", "size", "source_size", "target", every.alias("parts"))


#: A part's place in the order: finish time, then source by code point, null last; there is one part of a source at a time.
_PLACE = "struct({0}.finish as finish, source is null as last, coalesce(source, '') as source)"


def budget_end(queue: DataFrame, share: float = 1.0, steps: int | None = None):
    """The place of the part at which the budget (``share`` of all words) runs out, and the words left for it.

    None where the budget outlasts the queue. The words of each step of virtual time are summed
    first (a row a step); the parts of the one step in which the budget ends are then put in order.
    """
    steps = steps or 64 * partitions(queue.sparkSession)
    budget = int((queue.agg(F.sum("size")).first()[0] or 0) * share)
    each = queue.select("source", F.explode("parts").alias("part")).withColumn("step", F.floor(F.col("part.finish") * steps).cast("long"))
    sums = each.groupBy("step").agg(F.sum("part.words").alias("words"))
    before = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    through = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    last = through.where((F.col("before") <= budget) & (F.col("before") + F.col("words") > budget)).first()
    if last is None:
        return None
    place = F.expr(_PLACE.format("part"))
    own = each.where(F.col("step") == last["step"]).select(place.alias("place"), F.col("part.words").alias("words"))
    served = own.withColumn("before", F.lit(last["before"]) + F.coalesce(F.sum("words").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = served.where((F.col("before") <= budget) & (F.col("before") + F.col("words") > budget)).first()
    return cut["place"], budget - cut["before"]


def schedule(documents: DataFrame, size: str = "size", repeats: int = REPEATS, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0) -> DataFrame:
    """``row``, source, size, source_size, target and ``copies``, a list of (pass, finish, taken) of the parts
    of a document that the mix takes something of. The budget is ``share`` of all words."""
    # sizes are counted once for all that the end of the budget takes
    ids = Scratch(documents.sparkSession).write("sizes", need(documents, doc_id="string", source="string", **{size: "long"}))
    end = budget_end(queued(ids, size, repeats, weights, share), share)
    queue = queued(documents, size, repeats, weights, share)
    if end is None:
        copies = F.expr("transform(parts, c -> struct(c.pass as pass, c.finish as finish, c.words as taken))")
    else:
        place, left = end
        cut = F.struct(F.lit(float(place["finish"])).alias("finish"), F.lit(bool(place["last"])).alias("last"), F.lit(place["source"]).alias("source"))
        queue = queue.withColumn("__cut", cut)
        at = _PLACE.format("c")
        taken = f"case when {at} < __cut then c.words when {at} = __cut then {left}L else 0L end"
        copies = F.expr(f"filter(transform(parts, c -> struct(c.pass as pass, c.finish as finish, {taken} as taken)), c -> c.taken > 0)")
    return queue.select("row", "source", "size", "source_size", "target", copies.alias("copies"))


def stream(documents: DataFrame, size: str = "size", repeats: int = REPEATS, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0) -> DataFrame:
    """The mix itself: a row for each part taken, globally range-sorted by virtual finish time."""
    out = schedule(documents, size, repeats, weights, share).select("row", "source", F.explode("copies").alias("copy"))
    out = out.select("row", F.col("copy.pass").alias("mix_pass"), F.col("copy.finish").alias("mix_finish"), F.col("copy.taken").alias("mix_taken"), F.col("source").alias("mix_source"))
    return out.orderBy("mix_finish", F.col("mix_source").isNull(), "mix_source")


def mix(documents: DataFrame, repeats: int = REPEATS, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0) -> DataFrame:
    """``row`` (every column of ``documents``), size (words; null text: 0), source_size, target, taken, first_finish.

    A source whose documents have no words gets 0; an empty table gives none. Missing columns count
    as null.
    """
    inner = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    have = {c.lower() for c in documents.columns}
    col = lambda name: (F.col(f"row.`{name}`") if name in have else F.lit(None)).cast("string")
    sized = documents.select(inner).select("row", col("doc_id").alias("doc_id"), col("source").alias("source"), F.size(words(col("text"))).cast("long").alias("size"))
    out = schedule(sized, repeats=repeats, weights=weights, share=share)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda x, c: x + c["taken"])
    return out.select("row.row", "size", "source_size", "target", taken.alias("taken"), F.array_min(F.transform("copies", lambda c: c["finish"])).alias("first_finish"))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = need(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="long", text="string", source="string")
    # sizes first, so that no text is shuffled
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    out = schedule(Scratch(spark).write("sizes", sized))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda x, c: x + c["taken"])
    return out.select("row.doc_id", "size", "source_size", "target", taken.alias("taken"))


#: The same rows by DuckDB.
ORACLE = r"""
with d as (
  select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint as size,
    md5(coalesce(cast(doc_id as varchar), '')) as key
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (
  select *, case (row_number() over (order by source is null, encode(source)) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
    3 * source_size as most from s),
r as (select *, most / weight as ratio, sum(source_size) over () as budget from w),
l as (
  select *, (budget - coalesce(sum(most) over (order by ratio, source is null, encode(source) rows between unbounded preceding and 1 preceding), 0)::double)
    / sum(weight) over (order by ratio, source is null, encode(source) rows between current row and unbounded following) as level from r),
f as (select *, (select level from l where ratio > level order by ratio, source is null, encode(source) limit 1) as shared from l),
u as (select source, source_size, most, budget, least(most::double, coalesce(shared, 'inf'::double) * weight) as target from f),
t as (
  select source, source_size, target, floor(target)::bigint + case when floor(target) < most
      and row_number() over (order by target - floor(target) desc, source is null, encode(source)) <= budget - sum(floor(target)::bigint) over () then 1 else 0 end as quota from u),
c as (
  select d.doc_id, d.source, d.key, d.size, t.source_size, t.target, t.quota,
    sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and current row)::bigint as through,
    row_number() over (order by d.key, d.doc_id, d.source, d.size) as rn
  from d join t on d.source is not distinct from t.source),
k as (
  select *, p * source_size + through as upto, (p * source_size + through) / target as finish,
    greatest(0, least(size, quota - p * source_size - through + size))::bigint as head
  from c, (values (0), (1), (2)) v(p) where target > 0 and size > 0),
q as (
  select rn, source, least(finish, 1.0::double) as finish, head as words from k where head > 0
  union all select rn, source, finish, size - head from k where size > head),
o as (
  select rn, words, sum(words) over (order by finish, source is null, encode(source) rows between unbounded preceding and current row) - words as before from q),
g as (select rn, sum(greatest(0, least(words, (select sum(size) from d) - before)))::bigint as taken from o group by rn)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from c left join g using (rn)
"""

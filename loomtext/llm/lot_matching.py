"""Matching returned goods to the lots they came from.

Lots and returns of a client and item are one stream in order of day, a day's returns before its
lots. A lot that is shipped enters a container, a return takes units from it: the earliest from a
deque, the latest from a stack of day-runs, the costliest from a heap. Proration of costs and refunds
and the rows that come out are the same for all rules.

Scale: the stream of all clients and items is range-partitioned and sorted, so a pair of a third of
all rows is many partitions, and rows that are equal but for their number too. Pairs that end within a
partition are matched there. A pair that reaches a partition's edge is a chain of chunks, one a
partition. By the rule of the earliest, what is taken of a pair's lots is always the first units of
them, so the state between chunks is one number: a chunk says how many units it ships, how many it
wants and how far its wants run ahead of its lots, and sums and running minima over these few rows
(one for each pair and partition) give the units that were taken before it. The lots that it takes
from earlier chunks, and only these, are dealt to it by ranges of the pair's units; with them in its
deque it is matched by itself. The other two rules have no such number: a pair is one stream there,
read batch by batch with its open lots in memory.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, need, partitions

#: The order of a stream; ``kind`` is 0 for a return and 1 for a lot, ``n`` numbers rows that are equal otherwise.
ORDER = ["client_id", "item_id", "day", "kind", "sale_id", "line_no", "q", "c", "d", "n"]
STREAM = [*ORDER, "units"]
#: Where a line number is null; below all line numbers.
NO_LINE = -(1 << 40)

PIECE = ["client_id", "item_id", "return_no", "piece_no", "return_day", "return_sale_id", "lot_sale_id", "lot_line_no", "units", "lot_left", "refund_cents", "margin_cents"]
CHUNK = ["client_id", "item_id", "lots", "wanted", "low", "returns"]


class Lot:
    __slots__ = ("day", "sale", "line", "q", "c", "taken")

    def __init__(self, row: list[int], taken: int = 0):
        self.day, self.sale, self.line, self.q, self.c = row[2], row[4], row[5], row[6], row[7]
        self.taken = taken


class Earliest:
    """A deque: lots come in order of day and go from the front."""

    def __init__(self):
        self.lots: deque[Lot] = deque()

    def add(self, lot: Lot) -> None:
        self.lots.append(lot)

    def next(self) -> Lot | None:
        return self.lots[0] if self.lots else None

    def spent(self) -> None:
        self.lots.popleft()


class Latest:
    """A stack of days, each a run of its lots in order."""

    def __init__(self):
        self.runs: list[deque[Lot]] = []

    def add(self, lot: Lot) -> None:
        if not self.runs or self.runs[-1][0].day != lot.day:
            self.runs.append(deque())
        self.runs[-1].append(lot)

    def next(self) -> Lot | None:
        return self.runs[-1][0] if self.runs else None

    def spent(self) -> None:
        self.runs[-1].popleft()
        if not self.runs[-1]:
            self.runs.pop()


class Costliest:
    """A heap by cost of a unit; of equal ones the lot that came first."""

    def __init__(self):
        self.heap: list[tuple[Fraction, int, Lot]] = []
        self.came = 0

    def add(self, lot: Lot) -> None:
        heapq.heappush(self.heap, (Fraction(-lot.c, lot.q), self.came, lot))
        self.came += 1

    def next(self) -> Lot | None:
        return self.heap[0][2] if self.heap else None

    def spent(self) -> None:
        heapq.heappop(self.heap)


RULES: dict[str, Callable] = {"earliest": Earliest, "latest": Latest, "costliest": Costliest}


def settle(row: list[int], lots, number: int, out: list[tuple]) -> None:
    """Takes a return's units from the lots and adds its pieces to ``out``.

    The first n units of a lot cost floor(n*c/q), those of the return refund floor(n*c*(100-d)/(100*q));
    a piece has the differences.
    """
    client, item, day, _, sale, _, q, c, d, _, units = row[:11]
    left, given, refunded, piece = units, 0, 0, 0
    while left:
        lot = lots.next()
        piece += 1
        take = left if lot is None else min(left, lot.q - lot.taken)
        given += take
        total = given * c * (100 - d) // (100 * q)
        refund, refunded = total - refunded, total
        left -= take
        if lot is None:
            out.append((client, item, number, piece, day, sale, None, None, take, None, refund, None))
            return
        before = lot.taken * lot.c // lot.q
        lot.taken += take
        cost = lot.taken * lot.c // lot.q - before
        line = None if lot.line == NO_LINE else lot.line
        out.append((client, item, number, piece, day, sale, lot.sale, line, take, lot.q - lot.taken, refund, refund - cost))
        if lot.taken == lot.q:
            lots.spent()


def matched(rows: list[list[int]], lots, number: int = 0) -> list[tuple]:
    """Pieces of one stream; ``lots`` holds what is open before it and ``number`` counts the returns before it."""
    out: list[tuple] = []
    for row in rows:
        if row[3]:
            lots.add(Lot(row))
        else:
            number += 1
            settle(row, lots, number, out)
    return out


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names]) if batch.num_rows else np.zeros((0, len(names)), np.int64)


def _longs(rows: list[tuple] | np.ndarray, names: list[str]) -> pa.StructArray:
    columns = rows.T if isinstance(rows, np.ndarray) else list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


_EVENT = [*STREAM, "ahead"]
_STRUCT = lambda names: f"struct<{', '.join(f'{n}: bigint' for n in names)}>"
_FIRST = f"part int, piece {_STRUCT(PIECE)}, event {_STRUCT(_EVENT)}, chunk {_STRUCT(CHUNK)}"


def _edges(m: np.ndarray, keys: int) -> np.ndarray:
    """Where the key, the first ``keys`` columns, changes; with 0 and the end."""
    return np.concatenate([[0], np.flatnonzero((m[1:, :keys] != m[:-1, :keys]).any(axis=1)) + 1, [len(m)]])


def _chains(batches: Iterator[pa.RecordBatch], names: list[str], keys: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, edges, whether it reaches the end) of whole groups of a sorted stream; a group's rows are held until it ends."""
    held: list[np.ndarray] = []
    for batch in batches:
        m = _matrix(batch, names)
        if not len(m):
            continue
        if held and (held[-1][-1, :keys] != m[0, :keys]).any():
            own = np.concatenate(held)
            held = []
            yield own, np.array([0, len(own)]), False
        edges = _edges(m, keys)
        if len(edges) > 2:
            if held:
                own = np.concatenate([*held, m[: edges[1]]])
                held = []
                yield own, np.array([0, len(own)]), False
                m, edges = m[edges[1] :], edges[1:] - edges[1]
            if len(edges) > 2:
                yield m[: edges[-2]], edges[:-1], False
                m = m[edges[-2] :]
        held.append(m)
    if held:
        own = np.concatenate(held)
        yield own, np.array([0, len(own)]), True


def _within(rule: str):
    """Matches pairs that end within a partition; those at its edges come out as they are, with their chunk's sums."""
    schema = pa.schema([("part", pa.int32()), *((n, pa.struct([(c, pa.int64()) for c in names])) for n, names in (("piece", PIECE), ("event", _EVENT), ("chunk", CHUNK)))])

    def batch(part: int, **one) -> pa.RecordBatch:
        n = len(next(iter(one.values())))
        return pa.record_batch([pa.array([part] * n, pa.int32()), *(one.get(f.name, pa.nulls(n, f.type)) for f in list(schema)[1:])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = True
        for m, edges, last in _chains(batches, STREAM, 2):
            inner = edges
            if first or last:
                size = int(edges[1])
                yield from chunk(part, m[:size])
                first, inner = False, edges[1:]
            if len(inner) > 1:
                yield from whole(part, m, inner)

    def chunk(part: int, m: np.ndarray) -> Iterator[pa.RecordBatch]:
        lot = m[:, 3] == 1
        shipped, wanted = np.cumsum(np.where(lot, m[:, 6], 0)), np.cumsum(np.where(lot, 0, m[:, 10]))
        ahead = (shipped - wanted)[~lot]
        low = int(ahead.min()) if len(ahead) else None
        yield batch(part, chunk=_longs([(int(m[0, 0]), int(m[0, 1]), int(shipped[-1]), int(wanted[-1]), low, len(ahead))], CHUNK))
        yield batch(part, event=_longs(np.column_stack([m, np.where(lot, shipped - m[:, 6], 0)]), _EVENT))

    def whole(part: int, m: np.ndarray, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        returns = np.concatenate([[0], np.cumsum(m[:, 3] == 0)])
        out: list[tuple] = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if returns[b] > returns[a]:
                out += matched(m[a:b].tolist(), RULES[rule]())
        if out:
            yield batch(part, piece=_longs(out, PIECE))

    return run


#: Of a chunk's stream: what came before it, lots of earlier chunks, its own rows.
_HEAD, _CARRIED, _OWN = 0, 1, 2
_CHAINED = ["client_id", "item_id", "part", "place", *STREAM[2:], "first_unit", "taken_before", "returns_before"]


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches chunks that begin with lots of earlier ones in their deque."""
    for m, edges, _ in _chains(batches, _CHAINED, 3):
        out: list[tuple] = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            lots = Earliest()
            head, rows = m[a], m[a + 1 : b]
            taken, returns = int(head[14]), int(head[15])
            carried = int((rows[:, 3] == _CARRIED).sum())
            stream = np.column_stack([rows[:, :2], rows[:, 4:13]]).tolist()
            for row, at in zip(stream[:carried], rows[:carried, 13].tolist(), strict=True):
                lots.add(Lot(row, max(0, taken - at)))
            out += matched(stream[carried:], lots, returns)
        if out:
            yield pa.RecordBatch.from_struct_array(_longs(out, PIECE))


def _in_one(rule: str):
    """Matches streams of whole pairs, batch by batch, with the open lots in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lots, number = None, None, 0
        for batch in batches:
            out: list[tuple] = []
            for row in _matrix(batch, STREAM).tolist():
                if row[:2] != key:
                    key, lots, number = row[:2], RULES[rule](), 0
                if row[3]:
                    lots.add(Lot(row))
                else:
                    number += 1
                    settle(row, lots, number, out)
            if out:
                yield pa.RecordBatch.from_struct_array(_longs(out, PIECE))

    return run


def sold_lots(lines: DataFrame, sales: DataFrame) -> DataFrame:
    """Lots (client_id, item_id, day, sale_id, line_no, q, c, d) with ``units`` and ``return_day`` of what came back.

    A line without sale, item or day, of a sale without client or of no sale, of less than one unit, or whose
    amount is null, no number, infinite or reaches 10^13, is no lot. A discount that is null or not within
    +-1000 is 0; a null line number is kept, and its digits in the hash are none. Sales that stand there
    twice make each line two lots. Other columns are left alone, missing ones count as null.
    """
    lines = need(lines, sale_id="long", line_no="long", item_id="long", quantity="long", amount="double", discount="double", flag="string", shipped_at="timestamp_ntz")
    # comparisons leave out nulls, what is infinite and what is no number
    lines = lines.where("sale_id is not null and item_id is not null and shipped_at is not null and quantity >= 1 and abs(amount) < 1e13")
    discount = F.when(F.abs("discount") < 1000, F.col("discount")).otherwise(0.0)
    cents = lambda x: F.floor(100 * x + F.lit(0.5)).cast("long")
    h = F.crc32(F.concat(F.col("sale_id").cast("string"), F.lit(":"), F.coalesce(F.col("line_no").cast("string"), F.lit(""))).cast("binary"))
    back = F.col("flag") == "returned"
    lots = lines.select(
        "sale_id", F.coalesce("line_no", F.lit(NO_LINE)).alias("line_no"), "item_id", F.unix_date(F.to_date("shipped_at")).cast("long").alias("day"), F.col("quantity").alias("q"),
        cents(F.col("amount")).alias("c"), cents(discount).alias("d"), F.when(back, 1 + h % (F.col("quantity") + 1)).alias("units"), F.when(back, 1 + h % 7).alias("days"),
    )
    sold = need(sales, sale_id="long", client_id="long").where("sale_id is not null and client_id is not null")
    return lots.join(sold, "sale_id").select("client_id", "item_id", "day", "sale_id", "line_no", "q", "c", "d", "units", (F.col("day") + F.col("days")).alias("return_day"))


def _stream(lots: DataFrame) -> DataFrame:
    shipped = lots.select("client_id", "item_id", "day", F.lit(1).cast("long").alias("kind"), "sale_id", "line_no", "q", "c", "d", "n", F.lit(0).cast("long").alias("units"))
    back = lots.where("units is not null").select("client_id", "item_id", F.col("return_day").alias("day"), F.lit(0).cast("long").alias("kind"), "sale_id", "line_no", "q", "c", "d", "n", "units")
    return shipped.unionAll(back)


def _linked(chunks: DataFrame) -> DataFrame:
    """Chunks with what came before them: units shipped and taken, returns; ``taken`` with their own, ``width`` of the pair's ranges.

    With A units shipped and R wanted up to a return, R + min(0, least A - R so far) units are taken.
    """
    pair = Window.partitionBy("client_id", "item_id")
    through = pair.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = pair.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("lots", "wanted", "returns")}
    out = chunks.select("*", *[c.alias(n) for n, c in sums.items()], F.ceil(F.sum("lots").over(pair) / F.count("*").over(pair)).alias("width"))
    out = out.withColumn("reach", F.col("lots_before") - F.col("wanted_before") + F.col("low"))
    out = out.withColumn("taken", F.col("wanted_before") + F.col("wanted") + F.least(F.lit(0), F.min("reach").over(through)))
    out = out.withColumn("taken_before", F.coalesce(F.lag("taken").over(pair.orderBy("part")), F.lit(0)))
    return out.select("client_id", "item_id", "part", "lots_before", "returns_before", "taken_before", "taken", F.max("taken").over(pair).alias("taken_of_all"), F.greatest(F.lit(1), "width").cast("long").alias("width"))


_LINKS = ["lots_before", "taken", "taken_of_all", "width"]


def _carried(events: DataFrame, chunks: DataFrame) -> DataFrame:
    """(client_id, item_id, part, lot, first_unit) of the lots that a later chunk takes from, by that chunk."""
    nothing = lambda names: [F.lit(None).cast("long").alias(c) for c in names]
    key = ["client_id", "item_id", "part"]
    # a chunk's row stands among its lots, and a window over the chunk hands it on
    lots = events.where("kind = 1").select(*key, *_EVENT[2:], *nothing(_LINKS))
    both = lots.unionAll(chunks.select(*key, *nothing(_EVENT[2:]), *_LINKS))
    of_chunk = Window.partitionBy(*key)
    # by ranges, as the partitions were that chunks come from, so that chunks don't meet in a task by their hash
    both = both.repartitionByRange(partitions(events.sparkSession), "part", "client_id", "item_id")
    lots = both.withColumns({c: F.max(c).over(of_chunk) for c in _LINKS}).where("kind is not null").withColumn("first_unit", F.col("lots_before") + F.col("ahead"))
    lots = lots.where("first_unit < taken_of_all and first_unit + q > taken")
    ranges = lambda a, b: F.explode(F.sequence(F.floor(a / F.col("width")), F.floor((b - 1) / F.col("width"))))
    lots = lots.withColumn("low_range", F.floor(F.col("first_unit") / F.col("width"))).withColumn("range", ranges(F.col("first_unit"), F.col("first_unit") + F.col("q")))
    takers = chunks.withColumn("stop", F.least("taken", "lots_before")).where("taken_before < stop")
    takers = takers.select("client_id", "item_id", F.col("part").alias("to"), "taken_before", "stop", F.floor(F.col("taken_before") / F.col("width")).alias("low_taken"), ranges(F.col("taken_before"), F.col("stop")).alias("range"))
    out = lots.join(takers.hint("merge"), ["client_id", "item_id", "range"])
    # a lot and a chunk that share several ranges meet in the first of them
    out = out.where("to > part and range = greatest(low_range, low_taken) and first_unit < stop and first_unit + q > taken_before")
    return out.select("client_id", "item_id", F.col("to").alias("part"), *STREAM[2:], "first_unit")


def _dealt(events: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every chunk as a stream: what came before it, the lots of earlier chunks that it takes from, its own rows."""
    key = ["client_id", "item_id", F.col("part").cast("long").alias("part")]
    number = lambda n, name: F.lit(n).cast("long").alias(name)
    before = ["taken_before", "returns_before"]
    own = events.select(*key, number(_OWN, "place"), *STREAM[2:], number(0, "first_unit"), *[number(0, c) for c in before])
    carried = _carried(events, chunks).select(*key, number(_CARRIED, "place"), *STREAM[2:], "first_unit", *[number(0, c) for c in before])
    heads = chunks.select(*key, number(_HEAD, "place"), *[number(0, c) for c in [*STREAM[2:], "first_unit"]], *before)
    return heads.unionAll(carried).unionAll(own)


def match(lots: DataFrame, rule: str = "earliest") -> DataFrame:
    """Pieces of all returns, from lots as ``sold_lots`` gives them.

    One row for each lot that a return takes from, and one, without a lot and margin, for units that no
    lot has. Equal rows are lots and returns by themselves. No lots give no rows; a pair without returns
    gives none. A null line number sorts first and stays null.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}; there are {sorted(RULES)}")
    spark = lots.sparkSession
    scratch, n = Scratch(spark), partitions(spark)
    # the number of a row is written with it, so it stays the same however often later steps read it
    stream = _stream(scratch.write("lots", lots.withColumn("n", F.monotonically_increasing_id())))
    pieces = ", ".join(f"{c} long" for c in PIECE)
    if rule != "earliest":
        sorted_ = stream.repartition(n, "client_id", "item_id").sortWithinPartitions(*ORDER)
        return sorted_.select(*STREAM).mapInArrow(_in_one(rule), pieces)
    ranged = stream.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER).select(*STREAM)
    first = scratch.write("first", ranged.mapInArrow(_within(rule), _FIRST))
    chunks = scratch.write("chunks", _linked(first.where("chunk is not null").select("part", "chunk.*")))
    dealt = _dealt(first.where("event is not null").select("part", "event.*"), chunks)
    # chunks of neighbouring partitions, so that streams are as even as those were
    dealt = dealt.repartitionByRange(n, "part", "client_id", "item_id").sortWithinPartitions("client_id", "item_id", "part", "place", *ORDER[2:])
    return first.where("piece is not null").select("piece.*").unionAll(dealt.select(*_CHAINED).mapInArrow(_chained, pieces))


def op12(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return match(sold_lots(read("sale_lines"), read("sales")))


#: The same rows by DuckDB: what is taken of a pair's lots is a prefix of their units, so pieces are where intervals meet.
ORACLE = """
with crc as (select list_transform(range(0, 256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t),
l as (
  select s.client_id, x.item_id, (x.shipped_at::date - date '1970-01-01')::bigint as day, x.sale_id, coalesce(x.line_no::bigint, -1099511627776) as line_no, x.quantity::bigint as q,
    floor(100 * x.amount + 0.5)::bigint as c, floor(100 * case when abs(x.discount) < 1000 then x.discount else 0.0 end + 0.5)::bigint as d, x.flag = 'returned' as back,
    list_transform(string_split(x.sale_id || ':' || coalesce(x.line_no::varchar, ''), ''), lambda b: ascii(b)::bigint) as bytes
  from sale_lines x join sales s on s.sale_id = x.sale_id
  where s.client_id is not null and x.item_id is not null and x.shipped_at is not null and x.quantity >= 1 and abs(x.amount) < 1e13),
h as (select l.* exclude (bytes), xor(list_reduce(list_prepend(4294967295, bytes), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as h,
    row_number() over (order by client_id, item_id, day, sale_id, line_no, q, c, d) as n from l, crc),
e as (
  select client_id, item_id, day, 1 as kind, sale_id, line_no, q, c, d, n, 0::bigint as units from h
  union all select client_id, item_id, day + 1 + h % 7, 0, sale_id, line_no, q, c, d, n, 1 + h % (q + 1) from h where back),
w as (
  select *, sum(case when kind = 1 then q else 0 end) over o as shipped, sum(units) over o as wanted, sum(1 - kind) over o as return_no
  from e window o as (partition by client_id, item_id order by day, kind, sale_id, line_no, q, c, d, n rows between unbounded preceding and current row)),
lots as (select *, shipped - q as u0 from w where kind = 1),
m as (select *, wanted + least(0, min(shipped - wanted) over (partition by client_id, item_id order by return_no rows between unbounded preceding and current row)) as taken from w where kind = 0),
r as (select *, coalesce(lag(taken) over (partition by client_id, item_id order by return_no), 0) as before from m),
p as (
  select r.client_id, r.item_id, r.return_no, r.day, r.sale_id, r.q, r.c, r.d, lots.sale_id as lot_sale_id, lots.line_no as lot_line_no, lots.q as lot_q, lots.c as lot_c,
    greatest(u0, before) - u0 as low, least(u0 + lots.q, taken) - u0 as high, u0
  from r join lots on lots.client_id = r.client_id and lots.item_id = r.item_id and u0 < taken and u0 + lots.q > before
  union all
  select client_id, item_id, return_no, day, sale_id, q, c, d, null, null, null, null, 0, units - (taken - before), 9223372036854775807 from r where units > taken - before),
g as (
  select *, high - low as units, row_number() over o as piece_no, sum(high - low) over o as given
  from p window o as (partition by client_id, item_id, return_no order by u0 rows between unbounded preceding and current row)),
f as (select *, (given::hugeint * c * (100 - d)) // (100 * q) - ((given - units)::hugeint * c * (100 - d)) // (100 * q) as refund from g)
select client_id::bigint as client_id, item_id::bigint as item_id, return_no::bigint as return_no, piece_no::bigint as piece_no, day::bigint as return_day, sale_id::bigint as return_sale_id,
  lot_sale_id::bigint as lot_sale_id, nullif(lot_line_no, -1099511627776)::bigint as lot_line_no, units::bigint as units, (lot_q - high)::bigint as lot_left, refund::bigint as refund_cents,
  (refund - ((high * lot_c) // lot_q - (low * lot_c) // lot_q))::bigint as margin_cents
from f
"""

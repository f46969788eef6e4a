import datetime
import random
import zlib
from collections import Counter
from fractions import Fraction
from math import floor

import pytest

from loomtext.llm import lot_matching

LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"
START = datetime.datetime(2024, 1, 1)


def brute(lines, sales, rule="earliest"):
    """Every return looks at all lots of its client and item."""
    lots, back = {}, {}
    clients = {}
    for sale, client in sales:
        clients.setdefault(sale, []).append(client)
    for sale, line, item, _, q, amount, discount, flag, shipped in lines:
        for client in clients.get(sale, []) if sale is not None else []:
            if client is None or item is None or q is None or q < 1 or amount is None or amount != amount or abs(amount) >= 1e13 or shipped is None:
                continue
            day = (shipped - datetime.datetime(1970, 1, 1)).days
            c = floor(100 * amount + 0.5)
            d = floor(100 * (discount if discount is not None and abs(discount) < 1000 else 0.0) + 0.5)
            h = zlib.crc32(f"{sale}:{'' if line is None else line}".encode())
            ln = -1e9 if line is None else line
            lots.setdefault((client, item), []).append([day, sale, ln, q, c, d, 0])
            if flag == "returned":
                back.setdefault((client, item), []).append((day + 1 + h % 7, sale, ln, q, c, d, 1 + h % (q + 1)))
    out = []
    for key, returns in back.items():
        own = sorted(lots[key])
        for number, (day, sale, _, q, c, d, units) in enumerate(sorted(returns), 1):
            value = lambda n: n * c * (100 - d) // (100 * q)  # noqa: B023, E731
            given = piece = 0
            while given < units:
                piece += 1
                open_ = [x for x in own if x[0] < day and x[6] < x[3]]
                if not open_:
                    out.append((*key, number, piece, day, sale, None, None, units - given, None, value(units) - value(given), None))
                    break
                if rule == "earliest":
                    lot = open_[0]
                elif rule == "latest":
                    lot = next(x for x in open_ if x[0] == open_[-1][0])
                else:
                    lot = min(open_, key=lambda x: Fraction(-x[4], x[3]))
                take = min(units - given, lot[3] - lot[6])
                refund = value(given + take) - value(given)
                cost = (lot[6] + take) * lot[4] // lot[3] - lot[6] * lot[4] // lot[3]
                lot[6] += take
                given += take
                out.append((*key, number, piece, day, sale, lot[1], None if lot[2] == -1e9 else lot[2], take, lot[3] - lot[6], refund, refund - cost))
    return Counter(out)


def made(seed, n, hot=0.5):
    """Lines of few clients and items, one pair with most rows; nulls, ties and repeated rows."""
    rng = random.Random(seed)
    lines = []
    for _ in range(n):
        sale = 7 if rng.random() < hot else rng.randrange(20)
        lines.append([sale, rng.randint(1, 4), 1 if rng.random() < hot else rng.randrange(4), 0, rng.choice([1, 2, 5, 30]), rng.choice([1.005, 20.0, 99.99, 0.0, -3.5]), rng.choice([0.0, 0.05, 1.0]), rng.choice(["kept", "returned", "returned"]), START + datetime.timedelta(days=rng.randrange(30), hours=rng.randrange(24))])
        if rng.random() < 0.05:
            lines.append(list(lines[-1]))
        if rng.random() < 0.1:
            lines[-1][rng.choice([0, 1, 2, 4, 5, 6, 7, 8])] = None
        if rng.random() < 0.02:
            lines[-1][5] = rng.choice([float("nan"), float("inf"), 1e300])
        if rng.random() < 0.02:
            lines[-1][6] = rng.choice([float("nan"), float("-inf"), 1e300])
        if rng.random() < 0.02:
            lines[-1][4] = rng.choice([0, -3])
    return [tuple(x) for x in lines], [(k, None if k == 3 else k % 5) for k in range(20)] + [(7, 2), (4, 1), (None, 1)]


@pytest.mark.parametrize(("seed", "n"), [(1, 3000), (2, 400), (3, 30), (4, 1)])
def test_like_brute_force(spark, seed, n):
    lines, sales = made(seed, n)
    rows = lot_matching.match(lot_matching.sold_lots(spark.createDataFrame(lines, LINES), spark.createDataFrame(sales, "sale_id long, client_id long"))).collect()
    assert Counter(map(tuple, rows)) == brute(lines, sales)


@pytest.mark.parametrize("rule", ["latest", "costliest"])
def test_other_rules(spark, rule):
    lines, sales = made(5, 900)
    rows = lot_matching.match(lot_matching.sold_lots(spark.createDataFrame(lines, LINES), spark.createDataFrame(sales, "sale_id long, client_id long")), rule).collect()
    assert Counter(map(tuple, rows)) == brute(lines, sales, rule)
    with pytest.raises(ValueError, match="unknown rule"):
        lot_matching.match(spark.createDataFrame([], "units long"), "dearest")


def test_a_pair_is_dealt_to_many_tasks(spark):
    """Most rows are of one pair, which stands at the edges of nearly all partitions."""
    lines, sales = made(6, 4000, hot=0.95)
    lots = lot_matching.sold_lots(spark.createDataFrame(lines, LINES), spark.createDataFrame(sales, "sale_id long, client_id long"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        pieces = lot_matching.match(lots)
        rows = pieces.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert Counter(map(tuple, rows)) == brute(lines, sales)


def test_lots_carried_far(spark):
    """All lots come first, so each return takes from chunks long before its own."""
    days = lambda k: START + datetime.timedelta(days=k)
    lines = [(k, 1, 1, 0, 3, 10.0 + k, 0.1, "kept", days(0)) for k in range(500)] + [(k, 1, 1, 0, 50, 70.0, 0.1, "returned", days(10 + k % 80)) for k in range(500, 560)]
    sales = [(k, 1) for k in range(560)]
    rows = lot_matching.match(lot_matching.sold_lots(spark.createDataFrame(lines, LINES), spark.createDataFrame(sales, "sale_id long, client_id long"))).collect()
    assert Counter(map(tuple, rows)) == brute(lines, sales)


def test_odd_tables(spark):
    lines, sales = made(8, 50)
    clash = "row int, units int, day string, kind int, q double, c double, d string, n int, part int, piece string, event int, chunk int, own int, first_unit int, client_id string"
    many = ", ".join(LINES.split(", ")) + ", " + clash
    odd = spark.createDataFrame([(*x, *[None] * 15) for x in lines], many)
    sold = spark.createDataFrame([(*x, 1, "x") for x in sales], "sale_id long, client_id long, item_id int, flag string")
    assert Counter(map(tuple, lot_matching.match(lot_matching.sold_lots(odd, sold)).collect())) == brute(lines, sales)
    assert lot_matching.match(lot_matching.sold_lots(odd.limit(0), sold)).count() == 0
    assert lot_matching.match(lot_matching.sold_lots(odd, sold.limit(0))).count() == 0


def test_table(spark):
    at = "/root/testdata/sf0.001"
    lines = [tuple(r) for r in spark.read.parquet(f"{at}/sale_lines.parquet").select(*[c.split()[0] for c in LINES.split(", ")]).collect()]
    sales = [tuple(r) for r in spark.read.parquet(f"{at}/sales.parquet").select("sale_id", "client_id").collect()]
    assert Counter(map(tuple, lot_matching.op12(spark, at).collect())) == brute(lines, sales)

"""Get-or-insert in bulk against rows taken one at a time."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import dims
from ledgerloom.operators.ranking import IdRanges

LINES = (
    "company_id long, history_id long, line_no long, user_id long, descp string, "
    "hsn_sac string, uom string, rate double, gst double"
)
# Eight bills a range; the second stretch is cut into single bills.
RANGES = IdRanges(0, 3, {1: 0})
PARTY = "id long, company_id long, user_id long, bname string, bphno1 string, sname string, sphno1 string"


def random_lines(seed, bills, start=0):
    rng = random.Random(seed)
    rows = []
    for bill in range(start, start + bills):
        company = 0 if rng.random() < 0.5 else rng.randrange(1, 4)
        for line in range(1, rng.randrange(2, 6)):
            # One description takes a third of all lines; case matters.
            name = "bolt" if rng.random() < 0.33 else rng.choice(["Bolt", "nut", "rod", "gear"])
            if rng.random() < 0.2:
                name += str(rng.randrange(30))
            rows.append(
                (company, bill, line, 7, name, rng.choice(["", "h1"]), "u", rng.random(), 5.0)
            )
    return rows


def goods_one_by_one(rows, stored=None):
    goods = dict(stored or {})
    counts = {}
    for company, _ in goods:
        counts[company] = counts.get(company, 0) + 1
    for company, bill, line, _, name, hsn, _, rate, _ in sorted(rows, key=lambda r: r[:3]):
        if (company, name) not in goods:
            counts[company] = counts.get(company, 0) + 1
            goods[company, name] = (counts[company], rate, hsn or None)
    return goods


def goods_dict(df):
    return {(r.company_id, r.descp): (r.id, r.rate, r.hsn_sac) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_goods_first_one_wins(spark, seed):
    rows = random_lines(seed, 120)
    lines = spark.createDataFrame(rows, LINES).repartition(5)
    assert goods_dict(dims.goods_master(lines, RANGES)) == goods_one_by_one(rows)


@pytest.mark.parametrize("seed", range(3))
def test_goods_of_a_second_batch(spark, seed):
    first, second = random_lines(seed, 60), random_lines(seed + 50, 60, start=60)
    stored = dims.goods_master(spark.createDataFrame(first, LINES), RANGES).cache()
    fresh = dims.new_goods(spark.createDataFrame(second, LINES), stored)
    added = dims.with_ids(fresh, ["first_bill", "first_line"], stored, RANGES)
    got = {**goods_dict(stored), **goods_dict(added)}
    assert got == goods_one_by_one(first + second)
    assert dims.new_goods(spark.createDataFrame(first, LINES), stored).isEmpty()


def test_largest_id_wins_among_duplicate_descriptions(spark):
    goods = spark.createDataFrame(
        [(1, "a", 1), (1, "a", 4), (2, "a", 9)], "company_id long, descp string, id long"
    )
    lines = spark.createDataFrame([(1, "a"), (1, "A"), (2, "a")], "company_id long, descp string")
    got = {(r.company_id, r.descp): r.goods_id for r in dims.link_goods(lines, goods).collect()}
    assert got == {(1, "a"): 4, (1, "A"): None, (2, "a"): 9}


def random_bills(seed, n, start=0):
    rng = random.Random(seed)
    names, phones = ["Ann", "Bob", "Cy", ""], ["6000000001", "6000000002", "", ""]
    return [
        (
            bill,
            0 if rng.random() < 0.5 else 1,
            3,
            rng.choice(names),
            rng.choice(phones),
            rng.choice(names),
            rng.choice(phones),
        )
        for bill in range(start, start + n)
    ]


def parties_one_by_one(rows, stored=()):
    table = list(stored)  # (company, id, name, phone or None)
    links = {}

    def get_or_insert(company, name, phone):
        for c, ident, n, p in table:
            if (c, n) == (company, name) and p is not None and p == phone:
                return ident
        ident = 1 + sum(1 for row in table if row[0] == company)
        table.append((company, ident, name, phone or None))
        return ident

    for bill, company, _, bname, bphone, sname, sphone in rows:
        billed = get_or_insert(company, bname, bphone) if bname else None
        if (bname, bphone) == (sname, sphone):
            shipped = billed
        else:
            shipped = get_or_insert(company, sname, sphone) if sname else None
        links[bill] = (billed, shipped)
    return table, links


ATTRIBUTES = ["name", "phno1"]


@pytest.mark.parametrize("seed", range(4))
def test_parties_as_if_one_at_a_time(spark, seed):
    first, second = random_bills(seed, 40), random_bills(seed + 9, 40, start=40)
    table, links = parties_one_by_one(first)
    both, more_links = parties_one_by_one(second, table)

    bills = spark.createDataFrame(first, PARTY)
    mentions = dims.party_mentions(bills, ATTRIBUTES)
    stored = dims.client_master(mentions, RANGES).cache()
    ids = dims.party_ids(mentions, None, stored)
    got = {r.id: (r.billed_to, r.shipped_to) for r in dims.with_parties(bills, ids).collect()}
    assert got == links

    bills = spark.createDataFrame(second, PARTY)
    mentions = dims.party_mentions(bills, ATTRIBUTES)
    fresh = dims.with_ids(
        dims.new_clients(mentions, stored), ["first_bill", "first_role"], stored, RANGES
    )
    ids = dims.party_ids(mentions, stored, fresh)
    got = {r.id: (r.billed_to, r.shipped_to) for r in dims.with_parties(bills, ids).collect()}
    assert got == more_links
    columns = ["company_id", "id", "name", "phno1"]
    rows = stored.select(columns).unionByName(fresh.select(columns)).collect()
    order = lambda r: (r[0], r[1])
    assert sorted(map(tuple, rows), key=order) == sorted(both, key=order)


def test_ship_to_never_stores_a_gstin(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, "Ann", "6000000001", "G1", "Bob", "6000000002", "G2")],
        "id long, company_id long, user_id long, bname string, bphno1 string, bgstin string, "
        "sname string, sphno1 string, sgstin string",
    )
    got = dims.party_mentions(df, ["name", "phno1", "gstin"]).orderBy(F.col("role")).collect()
    assert [(r.name, r.gstin) for r in got] == [("Ann", "G1"), ("Bob", None)]

"""Bulk numbering against bills numbered one after the other."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import numbering
from ledgerloom.operators import ranking
from ledgerloom.operators.ranking import bucket_of, id_ranges, numbered

SCHEMA = "id long, company_id long, type string, bill_timestamp timestamp"


class Width:
    """Ranges of a fixed width."""

    def __init__(self, width):
        self.width = width

    def of(self, key):
        return bucket_of(key, self.width)


def make_bills(seed, n=600, start_id=0, start="1998-01-01"):
    """Time-ordered ids; company 0 has more than half of the bills."""
    rng = random.Random(seed)
    day = datetime.datetime.fromisoformat(start)
    rows = []
    for i in range(n):
        day += datetime.timedelta(days=rng.choice([0, 0, 1, 3, 20, 200]) if i % 7 == 0 else 0)
        company = 0 if rng.random() < 0.6 else rng.randrange(1, 5)
        rows.append((start_id + i * 3, company, rng.choice(["Invoice", "Quotation"]), day))
    return rows


def one_by_one(rows, seeds=None):
    last = dict(seeds or {})
    numbers = {}
    for bill, company, kind, at in sorted(rows):
        previous = last.get((company, kind))
        if previous is None:
            number = 1
        elif at.month >= 4 and previous[1] < 4:
            number = 1
        else:
            number = previous[0] + 1
        last[(company, kind)] = (number, at.month)
        numbers[bill] = number
    return numbers, last


def as_dict(df):
    return {r.id: r.bill_num for r in df.select("id", "bill_num").collect()}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("bucket", [7, 50, 10**6])
def test_numbers_equal_the_sequential_rule(spark, seed, bucket):
    rows = make_bills(seed)
    bills = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA)
    expected, _ = one_by_one(rows)
    assert as_dict(numbering.number_bills(bills, ranges=Width(bucket))) == expected


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("bucket", [5, 60, 10**6])
def test_late_bills_take_the_next_number(spark, seed, bucket):
    """Dates in any order: numbers follow the ids, restarts the months."""
    rng = random.Random(seed)
    rows = [
        (
            3 * i,
            0 if rng.random() < 0.6 else rng.randrange(1, 4),
            rng.choice(["Invoice", "Quotation"]),
            datetime.datetime(2000 + rng.randrange(3), rng.choice([2, 3, 4, 4, 5, 11]), 1),
        )
        for i in range(300)
    ]
    expected, _ = one_by_one(rows)
    bills = spark.createDataFrame(rng.sample(rows, len(rows)), SCHEMA)
    assert as_dict(numbering.number_bills(bills, ranges=Width(bucket))) == expected

    first, second = rows[:140], rows[140:]
    done = numbering.number_bills(spark.createDataFrame(first, SCHEMA), ranges=Width(bucket))
    more = numbering.number_bills(
        spark.createDataFrame(second, SCHEMA), numbering.last_bill(done), Width(bucket)
    )
    assert {**as_dict(done), **as_dict(more)} == expected


def test_fiscal_years_continue_from_the_last_bill(spark):
    rows = make_bills(2, 300)
    whole = numbering.number_bills(
        spark.createDataFrame(rows, SCHEMA), ranges=Width(40), mode="fiscal_year"
    )
    done = numbering.number_bills(
        spark.createDataFrame(rows[:120], SCHEMA), ranges=Width(40), mode="fiscal_year"
    )
    more = numbering.number_bills(
        spark.createDataFrame(rows[120:], SCHEMA),
        numbering.last_bill(done),
        Width(40),
        mode="fiscal_year",
    )
    assert {**as_dict(done), **as_dict(more)} == as_dict(whole)


@pytest.mark.parametrize("seed", range(3))
def test_a_second_batch_continues_the_first(spark, seed):
    rows = make_bills(seed)
    first, second = rows[:250], rows[250:]
    numbers, _ = one_by_one(rows)
    done = numbering.number_bills(spark.createDataFrame(first, SCHEMA), ranges=Width(40))
    seeds = numbering.last_bill(done)
    more = numbering.number_bills(spark.createDataFrame(second, SCHEMA), seeds, Width(40))
    assert {**as_dict(done), **as_dict(more)} == numbers


def test_no_restart_without_a_winter_bill(spark):
    rows = [
        (1, 1, "Invoice", datetime.datetime(2001, 5, 1)),
        (2, 1, "Invoice", datetime.datetime(2003, 6, 1)),
        (3, 1, "Invoice", datetime.datetime(2004, 2, 1)),
        (4, 1, "Invoice", datetime.datetime(2004, 4, 1)),
    ]
    bills = spark.createDataFrame(rows, SCHEMA)
    assert as_dict(numbering.number_bills(bills)) == {1: 1, 2: 2, 3: 3, 4: 1}
    by_year = numbering.number_bills(bills, mode="fiscal_year")
    assert as_dict(by_year) == {1: 1, 2: 1, 3: 2, 4: 1}


def test_next_number(spark):
    rows = [
        (None, None, 5, 1),
        (9, datetime.datetime(2024, 2, 1), 5, 1),
        (9, datetime.datetime(2024, 11, 1), 1, 10),
        (9, datetime.datetime(2023, 12, 1), 4, 10),
    ]
    for number, at, month, expected in rows:
        last = spark.createDataFrame([(number, at)], "bill_num long, bill_timestamp timestamp")
        got = numbering.next_bill_number(last, datetime.date(2025, month, 1)).first().next_num
        assert got == expected


def test_unknown_mode_is_refused(spark):
    with pytest.raises(ValueError):
        numbering.number_bills(spark.createDataFrame(make_bills(0, 3), SCHEMA), mode="weekly")


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("keys", [["k"], []])
def test_ranks_inside_a_hot_group(spark, keys, descending):
    rng = random.Random(3)
    ids = rng.sample(range(5000), 900)
    rows = [(0 if i % 3 else rng.randrange(4), v) for i, v in enumerate(ids)]
    df = spark.createDataFrame(rows, "k long, id long")
    got = numbered(df, keys, ["id"], bucket_of(F.col("id"), 100), "n", descending).collect()
    groups = {}
    for key, value in rows:
        groups.setdefault(key if keys else None, []).append(value)
    expected = {}
    for members in groups.values():
        for rank, value in enumerate(sorted(members, reverse=descending), 1):
            expected[value] = rank
    assert {r.id: r.n for r in got} == expected


def largest_range(df, ranges):
    counts = df.groupBy(ranges.of(F.col("id")).alias("r")).count()
    return counts.agg(F.max("count")).first()[0]


@pytest.mark.parametrize("shape", ["dense", "sparse", "one_day"])
def test_ranges_hold_about_equal_rows(spark, monkeypatch, shape):
    """Gaps between ids and a day with nearly all of them leave no large range."""
    monkeypatch.setattr(ranking, "ROWS_PER_RANGE", 50)
    monkeypatch.setattr(ranking, "RANGES", 16)
    monkeypatch.setattr(ranking, "RANGE_BITS", 4)
    rng = random.Random(4)
    ids = {
        "dense": list(range(4000)),
        "sparse": [rng.randrange(10**15) for _ in range(4000)],
        "one_day": [77 * 10**12 + i for i in range(3900)] + [d * 10**12 for d in range(100)],
    }[shape]
    df = spark.createDataFrame([(i,) for i in sorted(set(ids))], "id long")
    ranges = id_ranges(df, "id")
    assert largest_range(df, ranges) <= 2 * 4000 // 16 + 1
    rows = df.select("id", ranges.of(F.col("id")).alias("r")).orderBy("id").collect()
    assert [r.r for r in rows] == sorted(r.r for r in rows)
    got = numbered(df, [], ["id"], ranges.of(F.col("id")), "n").orderBy("id").collect()
    assert [r.n for r in got] == list(range(1, len(rows) + 1))


def test_thousands_of_crowded_stretches(spark):
    ranges = ranking.IdRanges(-5, 10, {p: p % 10 for p in range(0, 4000, 2)})
    df = spark.range(-5, 4_100_000, 97).withColumn("r", ranges.of(F.col("id")))
    got = [(r.id, r.r) for r in df.collect()]
    for value, start in got:
        offset = value + 5
        width = (offset >> 10) % 10 if (offset >> 10) % 2 == 0 and offset >> 10 < 4000 else 10
        assert start == offset >> width << width
    assert df.groupBy("r").count().agg(F.sum("count")).first()[0] == len(got)


def test_keyless_bills_are_numbered(spark):
    at = datetime.datetime(2001, 5, 1)
    rows = [(1, None, "Invoice", at), (2, None, "Invoice", at), (3, 1, None, at), (4, 1, "Invoice", None)]
    bills = spark.createDataFrame(rows, SCHEMA)
    assert as_dict(numbering.number_bills(bills)) == {1: 1, 2: 2, 3: 1, 4: 1}
    seeds = numbering.last_bill(numbering.number_bills(bills))
    more = spark.createDataFrame([(5, None, "Invoice", at)], SCHEMA)
    assert as_dict(numbering.number_bills(more, seeds)) == {5: 3}

"""Prices and totals against plain arithmetic."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import pricing

LINE = "company_id long, history_id long, rate double, qty double, gst double"


def priced(spark, rows):
    return pricing.price_lines(spark.createDataFrame(rows, LINE))


def test_one_line(spark):
    row = priced(spark, [(1, 1, 100.0, 2.0, 18.0)]).first()
    assert (row.amount, row.rate_wo_gst, row.amount_wo_gst) == (200.0, 82.0, 164.0)
    assert (row.gst_amount, row.cgst_percent, row.cgst_amount, row.sgst_amount) == (
        36.0, 9.0, 18.0, 18.0,
    )


def test_lines_match_python_arithmetic(spark):
    rng = random.Random(11)
    rows = [
        (
            1,
            i,
            round(rng.uniform(0.01, 5000), 2),
            rng.choice([1.0, 2.0, 7.0, round(rng.uniform(0.001, 50), 3)]),
            rng.choice([0.0, 5.0, 12.0, 18.0, 28.0, 0.25, 3.33]),
        )
        for i in range(3000)
    ]
    got = {r.history_id: r for r in priced(spark, rows).collect()}
    for _, i, rate, qty, gst in rows:
        net = round(rate * (1 - gst / 100), 2)
        half = round(gst / 2, 2)
        expected = (
            rate * qty,
            net,
            round(net * qty, 2),
            round((gst / 100) * (rate * qty), 2),
            half,
            round((half / 100) * (rate * qty), 2),
        )
        r = got[i]
        assert expected == (
            r.amount, r.rate_wo_gst, r.amount_wo_gst, r.gst_amount, r.cgst_percent, r.cgst_amount,
        )


@pytest.mark.parametrize(
    "rate, grand, off", [(0.5, 0, -0.5), (1.5, 2, 0.5), (2.5, 2, -0.5), (99.49, 99, -0.49)]
)
def test_grand_total_rounds_half_to_even(spark, rate, grand, off):
    row = pricing.sum_lines(priced(spark, [(1, 1, rate, 1.0, 0.0)])).first()
    assert (row.total_amount, row.grand_total, row.round_off) == (rate, grand, off)


def test_total_sums_unrounded_amounts(spark):
    rows = [(1, 1, 0.05, 0.1, 0.0), (1, 1, 0.05, 0.1, 0.0), (1, 1, 10.0, 1.2345, 0.0)]
    row = pricing.sum_lines(priced(spark, rows)).first()
    assert row.total_amount == 12.36 and row.total_qty == 1.434
    shown = pricing.preview_totals(spark.createDataFrame(rows, LINE)).first()
    assert (shown.preview_total, shown.total_amount) == (12.36, 12.36)


def test_preview_rounds_each_line_and_ties_up(spark):
    rows = [(1, i // 2, 0.125, 1.0, 0.0) for i in range(4)]
    for row in pricing.preview_totals(spark.createDataFrame(rows, LINE)).collect():
        assert (row.preview_total, row.total_amount, row.same_total) == (0.26, 0.25, False)


def test_absurd_tax_rate_does_not_stop_a_batch(spark):
    rows = [(1, 1, 10.0, 1.0, 1e300), (1, 2, 10.0, 1.0, 18.0)]
    got = {r.history_id: r for r in pricing.sum_lines(priced(spark, rows)).collect()}
    assert got[1].total_amount == 10.0 and got[1].sum_gst > 1e298
    assert got[2].sum_gst == 1.8


@pytest.mark.parametrize("each", [8e18, 3.9e12, -8e18, 5e25])
def test_sums_of_large_lines_neither_stop_nor_vanish(spark, each):
    rows = [(1, 1, each, 1.0, 18.0) for _ in range(1300)] + [(1, 2, 10.0, 1.0, 18.0)]
    got = {r.history_id: r for r in pricing.sum_lines(priced(spark, rows)).collect()}
    assert got[1].total_amount == pytest.approx(1300 * each, rel=1e-12)
    assert got[2].total_amount == 10.0
    assert got[1].total_qty == 1300.0


def test_tax_is_split_one_way_only(spark, sample):
    invoices = sample.headers().where("type = 'Invoice'")
    totals = pricing.sum_lines(pricing.price_lines(sample.lines(invoices)))
    placed = pricing.place_of_supply(
        invoices.select("id", "company_id", "billed_to"), sample.companies(), sample.clients()
    ).drop("company_id")
    split = pricing.split_tax(totals.join(placed, totals.history_id == placed.id))
    wrong = split.where(
        (F.col("total_gst_amount").isNull() == F.col("total_cgst_amount").isNull())
        | (~F.col("total_cgst_amount").eqNullSafe(F.col("total_sgst_amount")))
        | (F.abs(F.col("grand_total") - F.col("total_amount") - F.col("round_off")) > 1e-9)
    )
    assert wrong.count() == 0
    assert split.where("inter_state").count() > 0 and split.where("NOT inter_state").count() > 0


def test_buyer_without_state_is_elsewhere(spark):
    df = spark.createDataFrame(
        [("MH", "MH"), ("MH", "mh"), ("MH", ""), ("MH", None)], "a string, b string"
    )
    got = [r[0] for r in df.select(pricing.crosses_states("a", "b")).collect()]
    assert got == [False, True, True, True]


def test_posted_amount_is_compared_to_the_cent(spark):
    df = spark.createDataFrame(
        [("10.00", 10.0), ("10", 10.004), ("1.00", 10.0), ("x", 10.0), (None, 1.0)],
        "p string, a double",
    )
    got = df.select(pricing.posted_amount_matches(F.col("p"), F.col("a"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False]


def test_bill_without_lines_has_amount_zero(spark, sample):
    bills = pricing.with_amount(sample.headers(), sample.lines(sample.headers()))
    assert bills.count() == sample.headers().count()
    assert bills.where("amount = 0").count() > 0

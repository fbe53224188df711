"""Line prices, bill totals and the tax split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import exact_sum, money_sum, py_round
from ledgerloom.functions.text import preview_amount

BILL = ["company_id", "history_id"]


def line_amount() -> Column:
    return F.col("rate") * F.col("qty")


def gst_amount() -> Column:
    return py_round((F.col("gst") / 100) * F.col("amount"))


def cgst_percent() -> Column:
    return py_round(F.col("gst") / 2)


def price_lines(lines: DataFrame) -> DataFrame:
    """Price every line: tax-free rate and amount, and the tax of both kinds of bill.

    ``gst_amount`` applies to bills across states and to quotations, the CGST/SGST
    columns to bills inside one state.  The posted amount is never used.  The tax-free
    rate takes the tax off as a discount, and the tax is charged on the full amount.
    """
    return (
        lines.withColumn("amount", line_amount())
        .withColumn("rate_wo_gst", py_round(F.col("rate") * (1 - F.col("gst") / 100)))
        .withColumn("amount_wo_gst", py_round(F.col("rate_wo_gst") * F.col("qty")))
        .withColumn("gst_amount", gst_amount())
        .withColumn("cgst_percent", cgst_percent())
        .withColumn("cgst_amount", py_round((F.col("cgst_percent") / 100) * F.col("amount")))
        .withColumn("sgst_percent", F.col("cgst_percent"))
        .withColumn("sgst_amount", F.col("cgst_amount"))
    )


def whole_rupees(total: Column) -> Column:
    """Grand total: nearest whole number, a half goes to the even one."""
    return F.rint(total).try_cast("bigint")


def sum_lines(priced: DataFrame, by: list[str] = BILL, extra: tuple[Column, ...] = ()) -> DataFrame:
    """Totals per bill in one aggregation; ``round_off`` may be negative.

    The tax is summed for both kinds of bill; which sum counts is decided per bill, so
    the place of supply never has to be joined to the lines.
    """
    sums = priced.groupBy(*by).agg(
        exact_sum(F.col("qty"), 3).alias("total_qty"),
        exact_sum(F.col("amount"), 2).alias("total_amount"),
        money_sum(F.col("amount_wo_gst")).alias("total_amount_wo_gst"),
        money_sum(F.col("gst_amount")).alias("sum_gst"),
        money_sum(F.col("cgst_amount")).alias("sum_cgst"),
        *extra,
    )
    total, grand = F.col("total_amount"), F.col("grand_total")
    return sums.withColumn("grand_total", whole_rupees(total)).withColumn(
        "round_off", py_round(grand - total)
    )


def grand_totals(lines: DataFrame, by: list[str] = BILL) -> DataFrame:
    """Only the stored amount of each bill; reads rate and quantity, nothing else."""
    return lines.groupBy(*by).agg(whole_rupees(exact_sum(line_amount(), 2)).alias("amount"))


def with_amount(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Headers with their stored amount; a bill without lines has amount 0."""
    totals = grand_totals(lines, ["history_id"])
    return (
        headers.join(totals, headers.id == totals.history_id, "left")
        .drop("history_id")
        .withColumn("amount", F.coalesce("amount", F.lit(0).cast("bigint")))
    )


def with_lineless(headers: DataFrame, totals: DataFrame) -> DataFrame:
    """Totals of all bills; those of a bill without lines are 0."""
    bills = headers.select("company_id", F.col("id").alias("history_id"))
    numbers = {
        f.name: 0.0 if f.dataType.typeName() == "double" else 0
        for f in totals.schema.fields
        if f.name not in BILL
    }
    return bills.join(totals.drop("company_id"), "history_id", "left").fillna(numbers)


def place_of_supply(headers: DataFrame, companies: DataFrame, clients: DataFrame) -> DataFrame:
    """State of seller and buyer, and whether the bill crosses states.

    A buyer without a state counts as being elsewhere.
    """
    sellers = companies.select(
        F.col("id").alias("company_id"), F.col("addrState").alias("company_state")
    )
    buyers = clients.select(
        F.col("id").alias("billed_to"), F.col("addrState").alias("client_state")
    )
    return (
        headers.join(sellers, "company_id", "left")
        .join(buyers, "billed_to", "left")
        .withColumn("inter_state", crosses_states("company_state", "client_state"))
    )


def crosses_states(company_state: str, client_state: str) -> Column:
    return F.coalesce(F.col(company_state), F.lit("")) != F.coalesce(
        F.col(client_state), F.lit("")
    )


def split_tax(bills: DataFrame) -> DataFrame:
    """One GST total across states, two equal halves inside a state, never both."""
    inter = F.col("inter_state")
    half = F.when(~inter, F.col("sum_cgst"))
    return (
        bills.withColumn("total_gst_amount", F.when(inter, F.col("sum_gst")))
        .withColumn("total_cgst_amount", half)
        .withColumn("total_sgst_amount", half)
    )


def preview_totals(lines: DataFrame) -> DataFrame:
    """Total the entry form shows, a sum of rounded lines, next to the billed total."""
    totals = lines.groupBy(*BILL).agg(
        money_sum(preview_amount(F.col("rate"), F.col("qty"))).alias("preview_total"),
        exact_sum(line_amount(), 2).alias("total_amount"),
    )
    # The form leaves the field blank when the sum is zero.
    shown = F.when(F.col("preview_total") != 0, F.col("preview_total"))
    return totals.withColumn("preview_total", shown).withColumn(
        "same_total", F.coalesce(F.col("preview_total"), F.lit(0.0)) == F.col("total_amount")
    )


def posted_amount_matches(posted: Column, amount: Column) -> Column:
    """Whether the amount a form posted is the recomputed one, to the cent."""
    return F.coalesce(posted.try_cast("double") == py_round(amount), F.lit(False))

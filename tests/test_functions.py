"""Literal expectations for the column functions."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import checks, numeric, text
from ledgerloom.functions.sql import register_sql_functions


def values(spark, schema, rows, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def one(spark, schema, rows, column):
    return [r[0] for r in values(spark, schema, rows, column)]


def test_py_round_matches_python(spark):
    rng = random.Random(5)
    xs = [2.675, 0.125, 0.375, -0.004, 1e13 + 0.125, 123456789012.345, 0.0]
    xs += [k / 1000 for k in range(-3000, 3000, 5)] + [k / 8 for k in range(-400, 400)]
    xs += [rng.uniform(-1e5, 1e5) for _ in range(3000)]
    xs += [round(rng.uniform(0, 1e5), 2) * (1 - rng.randrange(28) / 100) for _ in range(3000)]
    got = one(spark, "x double", [(x,) for x in xs], numeric.py_round(F.col("x"), 2))
    assert got == [round(x, 2) for x in xs]
    got = one(spark, "x double", [(x,) for x in xs], numeric.py_round(F.col("x"), 3))
    assert got == [round(x, 3) for x in xs]


def test_py_round_keeps_null_and_nan(spark):
    got = one(spark, "x double", [(None,), (float("nan"),)], numeric.py_round(F.col("x")))
    assert got[0] is None and got[1] != got[1]


def test_to_fixed(spark):
    rows = [(0.125,), (0.375,), (0.625,), (1.005,), (-0.125,), (2.0,), (None,), (10.235,)]
    got = one(spark, "x double", rows, numeric.to_fixed(F.col("x")))
    assert got == [0.13, 0.38, 0.63, 1.0, -0.13, 2.0, None, 10.23]


@pytest.mark.parametrize(
    "posted, expected",
    [
        ("1e2", 100.0),
        ("1_0", 10.0),
        (".5", 0.5),
        ("5.", 5.0),
        ("+3", 3.0),
        ("-1", -1.0),
        ("1_000.25", 1000.25),
        ("1d", None),
        ("1f", None),
        ("inf", None),
        ("-Infinity", None),
        ("1e999", None),
        ("abc", None),
        ("", None),
        ("1__0", None),
        ("_1", None),
        ("0x10", None),
        ("1 0", None),
    ],
)
def test_parse_number(spark, posted, expected):
    assert one(spark, "s string", [(posted,)], numeric.parse_number(F.col("s"))) == [expected]


def test_parse_number_nan_never_passes_a_minimum(spark):
    parsed = numeric.parse_number(F.col("s"))
    assert values(
        spark, "s string", [("NaN",), ("0.001",)], F.isnan(parsed), numeric.at_least(parsed, 0.001)
    ) == [(True, False), (False, True)]


def test_within_step(spark):
    rows = [("2.5",), ("2.5005",), ("0.001",), ("100.0",), ("100.01",)]
    rows += [("1.00000000001",), ("1e20",), ("1_0.50",), ("25e-4",), ("0.000",), ("x",)]
    assert values(
        spark,
        "x string",
        rows,
        numeric.within_step(F.col("x"), 3),
        numeric.within_step(F.col("x"), 2, 100.0),
    ) == [
        (True, True), (False, False), (True, False), (True, True), (True, False),
        (False, False), (True, False), (True, True), (False, False), (True, True), (None, None),
    ]


def test_sums_do_not_depend_on_the_order(spark):
    """Large and small amounts in any order give the exact sum, without a limit in size."""
    from decimal import Decimal

    rng = random.Random(2)
    for big in (1e10, 123456789012345.25, 7e18, 1e21):
        numbers = [big, 0.005] + [0.1] * 999 + [-3.25, 4e9]
        exact = sum(Decimal(repr(x)) for x in numbers)
        found = set()
        for _ in range(3):
            rng.shuffle(numbers)
            df = spark.createDataFrame([(x,) for x in numbers], "x double").repartition(5)
            found.add(df.agg(numeric.exact_sum(F.col("x"), 2)).first()[0])
        assert found == {float(round(exact, 2))}
    nothing = spark.createDataFrame([(None,)], "x double")
    assert nothing.agg(numeric.exact_sum(F.col("x"), 2)).first()[0] is None


def stamp(s):
    return datetime.datetime.fromisoformat(s)


@pytest.mark.parametrize(
    "kind, at, num, stored, issued",
    [
        ("Invoice", "2023-11-05", 7, "INV-23/24-11-000007", "INV-23/24-11-000007"),
        ("Quotation", "2024-03-31", 7, "EST-23/24-03-000007", "EST-23/24-03-000007"),
        ("Invoice", "2009-04-01", 1, "INV-9/10-04-000001", "INV-09/10-04-000001"),
        ("Invoice", "1999-04-01", 1, "INV-99/100-04-000001", "INV-99/00-04-000001"),
        ("Invoice", "2000-01-01", 1, "INV--1/0-01-000001", "INV-99/00-01-000001"),
        ("Other", "2001-02-01", 1234567, "EST-0/1-02-1234567", "EST-00/01-02-1234567"),
    ],
)
def test_bill_labels(spark, kind, at, num, stored, issued):
    args = F.col("t"), F.col("at"), F.col("n")
    got = values(
        spark,
        "t string, at timestamp, n long",
        [(kind, stamp(at), num)],
        text.bill_label(*args),
        text.issue_label(*args),
        text.short_document_name(text.bill_label(*args)),
    )
    assert got == [(stored, issued, stored[-6:] + ".pdf")]


def test_issue_date(spark):
    rows = [("Invoice", stamp("2024-01-05")), ("Quotation", stamp("2024-01-05"))]
    got = one(spark, "t string, at timestamp", rows, text.issue_date_text(F.col("t"), F.col("at")))
    assert got == ["05-01-2024", "05/01/2024"]


def test_inr_and_percent(spark):
    rows = [(1234.5,), (1234567.0,), (0.0,), (None,), (18.0,)]
    assert values(
        spark, "x double", rows, text.inr(F.col("x")), text.percent(F.col("x"))
    ) == [
        ("₹1,234.50", "1234.5%"),
        ("₹1,234,567.00", "1234567.0%"),
        (None, "0.0%"),
        (None, None),
        ("₹18.00", "18.0%"),
    ]


@pytest.mark.parametrize(
    "amount, words",
    [
        (0, "Zero Rupees"),
        (1, "One Rupee"),
        (21, "Twenty-One Rupees"),
        (100, "One Hundred Rupees"),
        (110, "One Hundred And Ten Rupees"),
        (1001, "One Thousand And One Rupees"),
        (1234, "One Thousand, Two Hundred And Thirty-Four Rupees"),
        (100005, "One Lakh And Five Rupees"),
        (1234567, "Twelve Lakh, Thirty-Four Thousand, Five Hundred And Sixty-Seven Rupees"),
        (10000000, "One Crore Rupees"),
        (1230000045, "One Hundred And Twenty-Three Crore And Forty-Five Rupees"),
        (
            9999999999,
            "Nine Hundred And Ninety-Nine Crore, Ninety-Nine Lakh, Ninety-Nine Thousand, "
            "Nine Hundred And Ninety-Nine Rupees",
        ),
        (10**10, "One Thousand Crore Rupees"),
        (
            10**14 + 12_345 * 10**7 + 7,
            "One Crore, Twelve Thousand, Three Hundred And Forty-Five Crore And Seven Rupees",
        ),
        (2 * 10**14, "Two Crore Crore Rupees"),
    ],
)
def test_amount_words(spark, amount, words):
    got = one(spark, "n long", [(amount,)], text.amount_words(F.col("n")))
    assert got == [words + ", Zero Paise Only"]


def test_amount_words_outside_the_domain(spark):
    rows = [(-1,), (None,)]
    assert one(spark, "n long", rows, text.amount_words(F.col("n"))) == [None] * 2


def test_address_and_phones(spark):
    names = ", ".join(f"{c} string" for c in text.ADDRESS_PARTS + text.PHONE_PARTS)
    rows = [
        ("Mill", "4", "", "High St", None, "Pune", "411001", "MH", "", "9876543210"),
        (None,) * 8 + ("6000000000", "7000000000"),
    ]
    assert values(spark, names, rows, text.address(), text.phones()) == [
        ("Mill 4 High St Pune 411001 MH", "9876543210"),
        ("", "6000000000, 7000000000"),
    ]


def test_strip_removes_all_whitespace(spark):
    rows = [("\t a b \n",), ("\x1cx\x1f",), ("　é ",), ("",), (None,)]
    assert one(spark, "s string", rows, text.strip("s")) == ["a b", "x", "é", "", None]


@pytest.mark.parametrize(
    "posted, stored, refused",
    [
        ("2024-01-05", "05-01-2024", False),
        ("2024-1-5", "05-01-2024", False),
        ("2024-02-30", None, True),
        ("24-01-05", None, True),
        ("soon", None, True),
        ("", "", False),
    ],
)
def test_eta(spark, posted, stored, refused):
    got = values(
        spark, "e string", [(posted,)], text.eta_text(F.col("e")), text.eta_invalid(F.col("e"))
    )
    assert got == [(stored, refused)]


def test_contact_rules(spark):
    phones = ["6123456789", "5123456789", "612345678", "61234567890", "+916123456789"]
    pins = ["560001", "060001", "56001", "5600011"]
    mails = ["a#b@x.co", "a@x", "é@x.co", "a" * 65 + "@x.co", "a@b.c", "a b@x.co"]
    run = lambda rows, rule: one(spark, "s string", [(r,) for r in rows], rule(F.col("s")))
    assert run(phones, checks.is_valid_phno) == [True, False, False, False, False]
    assert run(pins, checks.is_valid_pncd) == [True, False, False, False]
    assert run(mails, checks.is_valid_email) == [True, False, True, False, False, False]
    blank = lambda c: checks.optional(checks.is_valid_phno, c)
    assert run(["", None, "1", "6123456789"], blank) == [True, True, False, True]


def test_patterns_mean_what_they_mean_in_python(spark):
    """Line ends and word characters differ between regular expression dialects."""
    ends = ["", "\n", "\r", "\u0085", "\u2028", " "]
    phones = ["6123456789" + e for e in ends]
    pins = ["560001" + e for e in ends]
    letters = ["é", "e\u0301", "²", "Ⅷ", "‿", "१", "字", "\u200d", "ª", "_", "€", "x"]
    mails = [f"a{c}b@x.co" for c in letters] + ["a@x.co" + e for e in ends]
    for rows, rule, pattern in (
        (phones, checks.is_valid_phno, checks.PHONE_PATTERN),
        (pins, checks.is_valid_pncd, checks.PINCODE_PATTERN),
        (mails, checks.is_valid_email, checks.EMAIL_PATTERN),
    ):
        got = one(spark, "s string", [(r,) for r in rows], rule(F.col("s")))
        assert got == [re.match(pattern, r) is not None for r in rows]


def test_eta_is_read_like_python_reads_it(spark):
    rows = [
        "2024-01- 5", "2024-1-05", "2024-12-31", "2023-02-29", "2024-02-29", "0000-01-01",
        "2024-00-10", "2024-10-00", "2024-1-", "2024-13-1", "2024-01-32", "20240101", "2024-01-0 ",
        "1999-9-9", "2024-01-1x", "2024/01/01",
    ]

    def expected(posted):
        try:
            return datetime.datetime.strptime(posted, "%Y-%m-%d").strftime("%d-%m-%Y")
        except ValueError:
            return None

    got = one(spark, "e string", [(r,) for r in rows], text.eta_text(F.col("e")))
    assert got == [expected(r) for r in rows]


def test_sql_functions(spark):
    register_sql_functions(spark)
    row = spark.sql(
        "SELECT inr(1234.5D), inr(0D), is_valid_phno('6123456789'), is_valid_pncd('060001'), "
        "is_valid_email('a#b@x.co'), is_valid_email('a@x'), "
        "bill_label('Invoice', TIMESTAMP '1999-04-01', 1), "
        "bill_label('Quotation', TIMESTAMP '2000-01-01', 1234567)"
    ).first()
    assert tuple(row) == (
        "₹1,234.50", None, True, False, True, False,
        "INV-99/100-04-000001", "EST--1/0-01-1234567",
    )


def test_plain_numbers_take_the_short_path_with_the_same_outcome(spark):
    texts = ["7", "12.", "0.25", "0.250", "0.255", "1_0.5", "1e2", "25e-3", "nan", "", "x", "9" * 400, "١", "5\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    out = rows.select(numeric.parse_number(t), numeric.within_step(t, 2), numeric.within_step(t, 2, 10.0))
    assert [tuple(r)[1:] for r in out.collect()] == [
        (True, True), (True, False), (True, True), (True, True), (False, False), (True, False),
        (True, False), (False, False), (None, False), (None, None), (None, None), (None, None),
        (None, None), (True, True),
    ]
    assert [r[0] for r in out.collect()][:8] == [7.0, 12.0, 0.25, 0.25, 0.255, 10.5, 100.0, 0.025]
    plan = rows.select(numeric.within_step(t, 3))._jdf.queryExecution().optimizedPlan().toString()
    assert "{0,3}" in plan

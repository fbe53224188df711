"""Rounding, exact sums and number parsing."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

# Decimals kept of each unrounded amount or quantity when they are summed.
SUM_DIGITS = 6

# What a form may send as a number: optional sign, digits with single underscores
# between them, optional fraction and exponent.
NUMBER_PATTERN = (
    r"^[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)"
    r"([eE][+-]?[0-9]+(_[0-9]+)*)?$"
)
NAN_PATTERN = r"(?i)^[+-]?nan$"
# Most numbers: a few digits, and a fraction perhaps.
PLAIN_PATTERN = r"\A[0-9]{1,15}(\.[0-9]{0,%d})?\z"


def py_round(value: Column, digits: int = 2) -> Column:
    """Round a double to the nearest decimal of its exact binary value.

    Away from a tie, ``rint(x * 10^k) / 10^k`` is that decimal, and it stays in plain
    double arithmetic.  Close to a tie, or for very large values, the scaled product
    cannot be trusted, so the number is formatted from its exact value instead.
    """
    scale = 10.0**digits
    scaled = value * scale
    distance = F.abs(F.abs(scaled - F.rint(scaled)) - 0.5)
    exact = F.call_function("format_number", value, F.lit("0." + "0" * digits)).try_cast("double")
    return F.when((F.abs(scaled) < 1e11) & (distance > 1e-4), F.rint(scaled) / scale).otherwise(
        exact
    )


def to_fixed(value: Column) -> Column:
    """Two decimals as a browser's ``toFixed(2)`` gives them: exact ties go up.

    A double lies exactly between two cents only when it is an odd number of eighths.
    """
    size = F.abs(value)
    up = F.signum(value) * F.floor(size * 100 + 0.5) / 100
    return F.when((size * 8) % 2 == 1, up).otherwise(py_round(value, 2))


# Amounts are summed in two whole numbers, thousands and units below a thousand.
LIMB = 1000
# Up to here 64-bit sums of both hold for as many rows as a document's array can have lines.
LIMB_END = 4e12
# Up to here a decimal sum holds for as many rows; a double has no digit below a million then.
DECIMAL_END = 1e22


def exact_sum(
    value: Column, digits: int, unit: int = SUM_DIGITS, window: WindowSpec | None = None
) -> Column:
    """Sum of a double column, rounded half-even to ``digits``, whatever the row order.

    Rows are added as whole thousands and as units of ten to the minus ``unit`` of the
    rest, both in 64-bit integers; the two sums meet as decimals.  Values of 4e12 and more
    are added as decimals in a third sum.  Neither overflows with 2**31 rows.  Only from 1e22
    on, where a total says no more than its size, are values added as doubles, so a sum is
    never lost and never stops a job; infinite values and NaN stay what they are.  NULL values
    are left out.  With a ``window`` the sum is taken over it instead of a group.
    """
    def total_of(part: Column) -> Column:
        return F.sum(part) if window is None else F.sum(part).over(window)

    size = F.abs(value)
    plain = size < LIMB_END
    rest = value % LIMB
    thousands = total_of(F.when(plain, F.rint((value - rest) / LIMB).cast("bigint")))
    units = total_of(F.when(plain, F.rint(rest * 10.0**unit).cast("bigint")))
    medium = ~plain & (size < DECIMAL_END)
    large = total_of(F.when(medium, value.try_cast("decimal(28,6)")))
    huge = total_of(F.when(size >= DECIMAL_END, value))
    step = F.lit(Decimal(1).scaleb(-unit))
    whole = thousands.cast("decimal(19,0)") * F.lit(Decimal(LIMB))
    small = (whole + units.cast("decimal(19,0)") * step).cast("decimal(38,6)")
    none = F.lit(Decimal(0)).cast("decimal(38,6)")
    exact = F.when(
        small.isNotNull() | large.isNotNull(), F.coalesce(small, none) + F.coalesce(large, none)
    )
    rounded = F.bround(exact, digits).cast("double")
    return F.when(huge.isNull(), rounded).otherwise(huge + F.coalesce(rounded, F.lit(0.0)))


def money_sum(value: Column) -> Column:
    """Sum of amounts that already have two decimals."""
    return exact_sum(value, 2, unit=2)


def parse_number(text: Column) -> Column:
    """Number a form field holds, NaN for ``nan``, NULL when it is not a finite number."""
    plain = F.regexp_replace(text, "_", "").try_cast("double")
    finite = F.when(F.abs(plain) < float("inf"), plain)
    return (
        F.when(text.rlike(PLAIN_PATTERN % 15), text.try_cast("double"))
        .when(text.rlike(NUMBER_PATTERN), finite)
        .when(text.rlike(NAN_PATTERN), F.lit(float("nan")))
    )


def at_least(value: Column, minimum: float) -> Column:
    """``value >= minimum`` where NaN never passes."""
    return (value >= F.lit(minimum)) & ~F.isnan(value)


def decimals_of(text: Column) -> Column:
    """Decimals of a posted number as written, trailing zeros not counted."""
    plain = F.regexp_replace(F.lower(text), "_", "")
    fraction = F.rtrim(F.regexp_extract(plain, r"\.([0-9]*)", 1), F.lit("0"))
    whole = F.regexp_extract(plain, r"^[+-]?([0-9]*)", 1)
    zeros = F.length(whole) - F.length(F.rtrim(whole, F.lit("0")))
    exponent = F.coalesce(F.regexp_extract(plain, r"e([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    places = F.when(F.length(fraction) > 0, F.length(fraction)).otherwise(-zeros) - exponent
    nothing = F.length(F.translate(F.concat(whole, fraction), "0", "")) == 0
    return F.when(nothing, 0).otherwise(F.greatest(places, F.lit(0)))


def within_step(text: Column, digits: int, maximum: float | None = None) -> Column:
    """True when a posted number has at most ``digits`` decimals and does not exceed
    ``maximum``; NULL for what is no number."""
    number = parse_number(text)
    fits = (
        F.when(text.rlike(PLAIN_PATTERN % digits), F.lit(True))
        .when(number.isNotNull() & ~F.isnan(number), decimals_of(text) <= digits)
    )
    return fits if maximum is None else fits & (number <= F.lit(float(maximum)))

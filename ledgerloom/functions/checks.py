"""Field rules.  Each returns a boolean column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted shapes of contact fields.
PHONE_PATTERN = r"^[6-9][0-9]{9}$"
PINCODE_PATTERN = r"^[1-9][0-9]{5}$"
EMAIL_PATTERN = r"^[\w!#$%&'*+/=?^`{|}~\.-]{1,64}@[a-zA-Z0-9.-]{1,255}\.[a-zA-Z]{2,}$"

# The same shapes in Java's syntax: only a line feed counts as a line end, and word
# characters are letters, numbers and the underscore of any script.
LINES = "(?d)"
JAVA_PHONE = LINES + PHONE_PATTERN
JAVA_PINCODE = LINES + PINCODE_PATTERN
JAVA_EMAIL = LINES + EMAIL_PATTERN.replace(r"\w", r"\p{L}\p{N}_")

GSTIN_LENGTH = 15
IFSC_LENGTH = 11
USERNAME_MIN_LENGTH = 5


def is_valid_phno(text: Column) -> Column:
    return text.rlike(JAVA_PHONE)


def is_valid_pncd(text: Column) -> Column:
    return text.rlike(JAVA_PINCODE)


def is_valid_email(text: Column) -> Column:
    return text.rlike(JAVA_EMAIL)


def optional(rule, text: Column) -> Column:
    """Apply ``rule`` only to a field that is filled in."""
    return text.isNull() | (text == "") | rule(text)


def has_length(text: Column, length: int) -> Column:
    return F.length(text) == length


def min_length(text: Column, length: int) -> Column:
    return F.length(text) >= length


def absent_fields(fields: dict[str, Column]) -> Column:
    """Names of the fields that were not sent at all, joined with ``, ``."""
    return F.concat_ws(", ", *[F.when(c.isNull(), F.lit(n)) for n, c in fields.items()])


def absent_or_empty_arrays(fields: dict[str, Column]) -> dict[str, Column]:
    """A repeated field without any value counts as absent."""
    return {n: F.when(F.size(c) > 0, c) for n, c in fields.items()}


def blank_fields(fields: dict[str, Column]) -> Column:
    """Names of the fields that are absent or blank, joined with ``, ``."""
    return F.concat_ws(
        ", ", *[F.when(c.isNull() | (c == ""), F.lit(n)) for n, c in fields.items()]
    )


def blank_line_fields(fields: dict[str, Column]) -> Column:
    """Names of the repeated fields with at least one blank value."""
    return F.concat_ws(
        ", ", *[F.when(F.exists(c, lambda x: x == ""), F.lit(n)) for n, c in fields.items()]
    )


def first_error(rules: list[tuple[Column, Column | str, int]]) -> tuple[Column, Column]:
    """Message and status of the first rule that fires; both NULL when none does."""
    message = F.coalesce(
        *[F.when(cond, F.lit(text) if isinstance(text, str) else text) for cond, text, _ in rules]
    )
    status = F.coalesce(*[F.when(cond, F.lit(code)) for cond, _, code in rules])
    return message, status

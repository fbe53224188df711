"""Labels, money text, addresses and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import to_fixed

# English number words.
BELOW_TWENTY = (
    "Zero One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve Thirteen "
    "Fourteen Fifteen Sixteen Seventeen Eighteen Nineteen"
).split()
TENS = "Twenty Thirty Forty Fifty Sixty Seventy Eighty Ninety".split()

# Parts of a printed address in printing order.
ADDRESS_PARTS = (
    "addrBnm",
    "addrBno",
    "addrFlno",
    "addrSt",
    "addrLoc",
    "addrDist",
    "addrPncd",
    "addrState",
)
PHONE_PARTS = ("phno1", "phno2")

# Every character that counts as whitespace in Unicode text.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())

INVOICE = "Invoice"
QUOTATION = "Quotation"


def strip_sql(name: str) -> str:
    """SQL that removes leading and trailing whitespace of any kind, not only spaces.

    Most values begin and end with a printable ASCII character and stay as they are; plain
    comparisons find them, as BETWEEN would add a column for each of its values.
    """
    whitespace = "".join(f"\\u{ord(c):04x}" for c in WHITESPACE)
    last = f"substring({name}, -1)"
    return (
        f"CASE WHEN {name} >= '!' AND {name} < '\\u0080' AND {last} >= '!' AND {last} < '\\u0080' "
        f"THEN {name} ELSE trim(BOTH '{whitespace}' FROM {name}) END"
    )


def strip(name: str) -> Column:
    """The named text column without whitespace around it."""
    return F.expr(strip_sql(name))


def strip_all(name: str) -> Column:
    """The named array of texts, each without whitespace around it."""
    return F.expr(f"transform({name}, x -> {strip_sql('x')})")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def null_to_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def is_blank(text: Column) -> Column:
    return text.isNull() | (text == "")


def join_non_blank(separator: str, *parts: Column) -> Column:
    return F.concat_ws(separator, *[blank_to_null(p) for p in parts])


def address(prefix: str = "") -> Column:
    """One-line address from the eight address columns starting with ``prefix``."""
    return join_non_blank(" ", *[F.col(prefix + part) for part in ADDRESS_PARTS])


def phones(prefix: str = "") -> Column:
    return join_non_blank(", ", *[F.col(prefix + part) for part in PHONE_PARTS])


def inr(value: Column) -> Column:
    """Rupee text with thousands separators; NULL for NULL and for zero."""
    return F.when(value != 0, F.concat(F.lit("₹"), F.format_number(value.cast("double"), 2)))


def percent(value: Column) -> Column:
    return F.concat(value.cast("string"), F.lit("%"))


def bill_prefix(bill_type: Column) -> Column:
    return F.when(bill_type == INVOICE, F.lit("INV")).otherwise(F.lit("EST"))


def fiscal_start_year(at: Column) -> Column:
    """Calendar year in which the fiscal year of ``at`` began; it begins in April."""
    return F.year(at) - F.when(F.month(at) < 4, 1).otherwise(0)


def fiscal_year_label(at: Column) -> Column:
    """Two-digit years without padding, taken from the year's last two digits."""
    short = F.year(at) % 100
    start = F.when(F.month(at) > 3, short).otherwise(short - 1)
    return F.concat_ws("/", start.cast("string"), (start + 1).cast("string"))


def bill_label(bill_type: Column, at: Column, number: Column) -> Column:
    """Label of a stored bill."""
    return F.concat(
        bill_prefix(bill_type),
        F.lit("-"),
        fiscal_year_label(at),
        F.format_string("-%02d-%06d", F.month(at), number),
    )


def issue_label(bill_type: Column, on: Column, number: Column) -> Column:
    """Label printed when a bill is issued: both years padded to two digits."""
    start = fiscal_start_year(on)
    return F.concat(
        bill_prefix(bill_type),
        F.format_string(
            "-%02d/%02d-%02d-%06d", start % 100, (start + 1) % 100, F.month(on), number
        ),
    )


def issue_date_text(bill_type: Column, on: Column) -> Column:
    """Issue date as printed: dashes on invoices, slashes on quotations."""
    return F.when(bill_type == INVOICE, F.date_format(on, "dd-MM-yyyy")).otherwise(
        F.date_format(on, "dd/MM/yyyy")
    )


def document_name(label: Column) -> Column:
    return F.concat(label, F.lit(".pdf"))


def short_document_name(label: Column) -> Column:
    return F.concat(F.right(label, F.lit(6)), F.lit(".pdf"))


def eta_date(text: Column) -> Column:
    """Date of a ``YYYY-MM-DD`` field, NULL when it is not a date.

    Month and day may have one digit, the day also a space instead of a zero.
    """
    shaped = text.rlike(r"^[0-9]{4}-[0-9]{1,2}-( [1-9]|[0-9]{1,2})$") & ~text.startswith("0000")
    return F.when(shaped, F.try_to_date(F.translate(text, " ", "0"), "yyyy-M-d"))


def eta_invalid(text: Column) -> Column:
    return (text != "") & eta_date(text).isNull()


def eta_text(text: Column) -> Column:
    """ETA as stored: ``dd-MM-yyyy``, blank stays blank, NULL when refused."""
    return F.when(text == "", F.lit("")).otherwise(F.date_format(eta_date(text), "dd-MM-yyyy"))


def _small_words() -> Column:
    words = list(BELOW_TWENTY)
    for ten in TENS:
        words.append(ten)
        words.extend(f"{ten}-{unit}" for unit in BELOW_TWENTY[1:10])
    return F.array(*[F.lit(w) for w in words])


CRORE = 10**7


def _whole_words(number: Column, crore_levels: int) -> Column:
    """Words of a whole number; the crores are written by the same rules."""
    words = _small_words()

    def div(n: Column, divisor: int) -> Column:
        return F.call_function("div", n, F.lit(divisor).cast("bigint"))

    def small(n: Column) -> Column:
        return F.element_at(words, n.cast("int") + 1)

    def named(n: Column, name: str) -> Column:
        return F.when(n > 0, F.concat(small(n), F.lit(" " + name)))

    below = number % CRORE
    groups = [
        named(div(below, 10**5), "Lakh"),
        named(div(below, 10**3) % 100, "Thousand"),
        named(div(below, 100) % 10, "Hundred"),
    ]
    if crore_levels:
        crores = div(number, CRORE)
        crore = F.concat(_whole_words(crores, crore_levels - 1), F.lit(" Crore"))
        groups.insert(0, F.when(crores > 0, crore))
    rest = number % 100
    low = F.when((rest > 0) | (number < 100), small(rest))
    high = F.when(number >= 100, F.concat_ws(", ", *groups))
    return F.concat_ws(" And ", high, low)


def amount_words(amount: Column) -> Column:
    """Whole rupees in words, counted in crore, lakh, thousand and hundred.

    Crores above a thousand are counted like any number, up to the largest 64-bit amount;
    NULL for negative ones.
    """
    amount = amount.cast("bigint")
    unit = F.when(amount == 1, F.lit(" Rupee")).otherwise(F.lit(" Rupees"))
    # The largest amount has crores of crores, but no third level.
    text = F.concat(_whole_words(amount, 2), unit, F.lit(", Zero Paise Only"))
    return F.when(amount >= 0, text)


def preview_amount(rate: Column, qty: Column) -> Column:
    """Line amount as the entry form shows it; NULL while rate or quantity is missing."""
    return to_fixed(qty * rate)

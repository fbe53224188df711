"""Rules for submitted documents; the first broken rule names the error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import checks
from ledgerloom.functions.numeric import at_least, parse_number, within_step
from ledgerloom.functions.text import (
    INVOICE,
    blank_to_null,
    eta_invalid,
    eta_text,
    null_to_blank,
    strip,
    strip_all,
)
from ledgerloom.sources.schema import GOODS_FIELDS, INVOICE_INFO_FIELDS, PARTY_FIELDS, RESCUED

# Smallest accepted numbers of a line, and the refusal texts.
LINE_MINIMA = {"qty": 0.001, "rate": 0.01, "gst": 0.0}
REQUIRED_LINE_FIELDS = ("descp", "qty", "rate", "gst")
ABSENT_SUFFIX = " not provided"
BAD_NUMBER = "Invalid values in qty or rate or gst"
BAD_LENGTH = (
    "All fields in the list of goods must have the same length and "
    "qty, rate, gst fields must be higher than their minimum values"
)
BAD_PINCODE = "Invalid Pincode"
BAD_PHONE = "Invalid Phone Number"
BAD_MOBILE = "Invalid mobile number"
BAD_ETA = "Invalid values in ETA"
REFUSED = 403
# Refusals of this library: what arrives without a key cannot be stored, and a submission
# is handled once.
NO_KEY = "submission_id, company_id or bill_date not provided"
UNREADABLE = "Record could not be read"
REPEATED = "Submission already handled"
CONFLICT = 409

# Browser-side limits of the entry forms: reported as warnings, never refused.
STEPS = {"qty": (3, None), "rate": (2, None), "gst": (2, 100.0)}


def scalar_fields(kind: str) -> list[str]:
    if kind == INVOICE:
        parties = ["b" + f for f in PARTY_FIELDS] + ["s" + f for f in PARTY_FIELDS]
        return parties + list(INVOICE_INFO_FIELDS)
    return ["qname", "phno1", "eta"]


def posted_name(column: str) -> str:
    """Name of the form field behind a column."""
    return column.replace("_mode", "-mode").replace("total_amount", "total-amount")


def default_ship_to(df: DataFrame) -> DataFrame:
    """Fill the shipping party from the billing party where the form asked for it."""
    copied = {f: "same_info" for f in ("name", "phno1", "phno2")}
    copied.update({f: "same_address" for f in PARTY_FIELDS if f.startswith("addr")})
    return df.withColumns(
        {
            "s" + f: F.when(F.col(flag), F.col("b" + f)).otherwise(F.col("s" + f))
            for f, flag in copied.items()
        }
    )


def missing_fields(kind: str) -> Column:
    """Absent fields in the order the form lists them."""
    scalars = scalar_fields(kind)
    split = len(PARTY_FIELDS) * 2 if kind == INVOICE else 2
    fields = {posted_name(c): F.col(c) for c in scalars[:split]}
    fields.update(checks.absent_or_empty_arrays({c: F.col(c) for c in GOODS_FIELDS}))
    fields.update({posted_name(c): F.col(c) for c in scalars[split:]})
    fields["total-amount"] = F.col("total_amount")
    return checks.absent_fields(fields)


def stripped(df: DataFrame, kind: str) -> DataFrame:
    scalars = {c: strip(c) for c in scalar_fields(kind)}
    arrays = {c: strip_all(c) for c in GOODS_FIELDS}
    return df.withColumns({**scalars, **arrays})


def _passes(minimum: float):
    return lambda x: at_least(x, minimum)


def numbers_of(field: str) -> str:
    """Column with the parsed numbers of a repeated field."""
    return f"{field}_numbers"


def line_checks(df: DataFrame) -> DataFrame:
    """Parse the repeated goods fields (already stripped) and add the outcome of their rules.

    A number below its minimum is dropped from its array, which then differs in length
    from the others: one bad line refuses the whole document.
    """
    parsed = df.withColumns({numbers_of(f): F.transform(f, parse_number) for f in LINE_MINIMA})
    unreadable = F.lit(False)
    lengths = [F.size(f) for f in GOODS_FIELDS if f not in LINE_MINIMA]
    for field, minimum in LINE_MINIMA.items():
        unreadable = unreadable | F.exists(numbers_of(field), lambda x: x.isNull())
        lengths.append(F.size(F.filter(numbers_of(field), _passes(minimum))))
    return parsed.withColumns(
        {
            "blank_line_fields": checks.blank_line_fields(
                {f: F.col(f) for f in REQUIRED_LINE_FIELDS}
            ),
            "bad_number": F.coalesce(unreadable, F.lit(False)),
            "bad_length": F.size(F.array_distinct(F.array(*lengths))) != 1,
        }
    )


def _any_invalid(rule, *columns: str) -> Column:
    bad = F.lit(False)
    for c in columns:
        bad = bad | ~checks.optional(rule, F.col(c))
    return bad


def contact_checks(df: DataFrame, kind: str) -> DataFrame:
    """Add the outcome of the rules on pin codes, phones and the ETA."""
    if kind == INVOICE:
        pincode = _any_invalid(checks.is_valid_pncd, "baddrPncd", "saddrPncd")
        phone = _any_invalid(checks.is_valid_phno, "bphno1", "bphno2", "sphno1", "sphno2")
    else:
        pincode = F.lit(False)
        phone = _any_invalid(checks.is_valid_phno, "phno1")
    return df.withColumns(
        {
            "bad_pincode": pincode,
            "bad_phone": phone,
            "bad_eta": F.coalesce(eta_invalid(F.col("eta")), F.lit(False)),
        }
    )


def validate(df: DataFrame, kind: str) -> DataFrame:
    """Strip all fields and add ``error_message`` / ``error_status`` of the first failure.

    The message is generated, as a filter on it would else be pushed below the rules and repeat
    there every step that leads to them.
    """
    flagged = contact_checks(
        line_checks(stripped(df.withColumn("missing", missing_fields(kind)), kind)), kind
    )
    message, status = checks.first_error(
        [
            (F.col("missing") != "", F.concat("missing", F.lit(ABSENT_SUFFIX)), REFUSED),
            (
                F.col("blank_line_fields") != "",
                F.concat("blank_line_fields", F.lit(ABSENT_SUFFIX)),
                REFUSED,
            ),
            (F.col("bad_number"), BAD_NUMBER, REFUSED),
            (F.col("bad_length"), BAD_LENGTH, REFUSED),
            (F.col("bad_pincode"), BAD_PINCODE, REFUSED),
            (F.col("bad_phone"), BAD_PHONE if kind == INVOICE else BAD_MOBILE, REFUSED),
            (F.col("bad_eta"), BAD_ETA, REFUSED),
        ]
    )
    return flagged.withColumn("error_status", status).withColumn(
        "error_message", F.explode(F.array(message))
    )


def refuse_unreadable(validated: DataFrame) -> DataFrame:
    """Refuse records that were not read whole; their text goes along."""
    torn = F.col(RESCUED).isNotNull()
    return validated.withColumns(
        {
            "error_message": F.when(torn, F.lit(UNREADABLE)).otherwise(F.col("error_message")),
            "error_status": F.when(torn, F.lit(REFUSED)).otherwise(F.col("error_status")),
        }
    )


def repeated_ids(
    validated: DataFrame, row: str, stored_ids: DataFrame | None = None
) -> DataFrame:
    """Ids that occur twice, with the lowest ``row`` of each, and ids that are stored.

    One row per id; of the documents only ids and row numbers are shuffled.
    """
    arrived = validated.groupBy(F.col("submission_id").alias("_id")).agg(
        F.count("*").alias("_times"), F.min(row).alias("_first")
    ).where(F.col("_id").isNotNull())
    if stored_ids is None:
        arrived = arrived.withColumn("_known", F.lit(False))
    else:
        known = stored_ids.select(F.col("id").alias("_id")).join(
            arrived.select("_id"), "_id", "left_semi"
        )
        known = known.distinct().withColumn("_known", F.lit(True))
        arrived = arrived.join(known, "_id", "left").withColumn(
            "_known", F.coalesce("_known", F.lit(False))
        )
    return arrived.where((F.col("_times") > 1) | F.col("_known")).drop("_times")


def refuse_repeated(
    validated: DataFrame,
    row: str,
    stored_ids: DataFrame | None = None,
    repeated: DataFrame | None = None,
) -> DataFrame:
    """Refuse documents without a key, all but one of those with the same id, and those
    whose id is stored.

    ``row`` numbers the rows; the lowest of a repeated id stays.  ``repeated`` holds the
    result of ``repeated_ids`` where it has been written: its size is known then, and the
    documents are not shuffled for a few ids.
    """
    if repeated is None:
        repeated = repeated_ids(validated, row, stored_ids)
    df = validated.join(repeated, F.col("submission_id") == F.col("_id"), "left").drop("_id")
    again = F.coalesce(F.col(row) != F.col("_first"), F.lit(False)) | F.coalesce(
        "_known", F.lit(False)
    )
    keyless = F.lit(False)
    for key in ("submission_id", "company_id", "bill_date"):
        keyless = keyless | F.col(key).isNull()
    message = (
        F.when(keyless, F.lit(NO_KEY)).when(again, F.lit(REPEATED)).otherwise(
            F.col("error_message")
        )
    )
    status = (
        F.when(keyless, F.lit(REFUSED)).when(again, F.lit(CONFLICT)).otherwise(
            F.col("error_status")
        )
    )
    return df.withColumns({"error_message": message, "error_status": status}).drop(
        "_first", "_known"
    )


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("error_message").isNull())


def rejects(validated: DataFrame) -> DataFrame:
    text = [RESCUED] if RESCUED in validated.columns else []
    return validated.where(F.col("error_message").isNotNull()).select(
        "submission_id", "company_id", "error_message", "error_status", *text
    )


def explode_lines(valid: DataFrame) -> DataFrame:
    """Validated documents as lines: parallel arrays become rows."""
    zipped = F.arrays_zip(
        "descp", "hsn_sac", "uom", "amount", *[numbers_of(f) for f in LINE_MINIMA]
    )
    lines = valid.select(
        "company_id",
        "user_id",
        F.col("id").alias("history_id"),
        F.posexplode(zipped).alias("position", "line"),
    )
    return lines.select(
        "company_id",
        "user_id",
        "history_id",
        (F.col("position") + 1).cast("bigint").alias("line_no"),
        F.col("line.descp").alias("descp"),
        blank_to_null(F.col("line.hsn_sac")).alias("hsn_sac"),
        blank_to_null(F.col("line.uom")).alias("uom"),
        F.col("line.amount").alias("posted_amount"),
        *[F.col("line." + numbers_of(f)).alias(f) for f in LINE_MINIMA],
    )


def _off_step(decimals: int, maximum: float | None):
    return lambda x: ~within_step(x, decimals, maximum)


def step_warnings(df: DataFrame) -> DataFrame:
    """Count the numbers outside the browser's step or maximum, per field."""
    counts = {}
    for field, (decimals, maximum) in STEPS.items():
        off = F.filter(strip_all(field), _off_step(decimals, maximum))
        # A document without lines has nothing off.
        counts[f"{field}_off_step"] = F.greatest(F.coalesce(F.size(off), F.lit(0)), F.lit(0)).cast("bigint")
    return df.withColumns(counts)


def normalised_eta(df: DataFrame) -> DataFrame:
    return df.withColumn("eta_text", eta_text(strip("eta")))


def blank_parties(valid: DataFrame, kind: str) -> DataFrame:
    """Bring both kinds of document to the same party columns, b* and s*."""
    if kind == INVOICE:
        return valid.withColumns(
            {p + f: null_to_blank(F.col(p + f)) for p in "bs" for f in PARTY_FIELDS}
        )
    columns = {"b" + f: F.lit("") for f in PARTY_FIELDS}
    columns.update({"s" + f: F.lit("") for f in PARTY_FIELDS})
    columns["bname"], columns["bphno1"] = F.col("qname"), F.col("phno1")
    columns["transport_mode"] = columns["payment_mode"] = F.lit(None).cast("string")
    return valid.withColumns(columns)

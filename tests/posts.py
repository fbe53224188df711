"""Hand-made submissions."""

import datetime

from ledgerloom.functions.text import INVOICE
from ledgerloom.sources.schema import INVOICE_SUBMISSION, QUOTATION_SUBMISSION

GOODS = {
    "serialNumber": ["1", "2"],
    "descp": ["bolt", "nut"],
    "hsn_sac": ["h", ""],
    "qty": ["2", "1.5"],
    "uom": ["kg", ""],
    "rate": ["100", "10"],
    "amount": ["200.00", "15.00"],
    "gst": ["18", "0"],
}


def _row(schema, number, date, fields):
    row = {f.name: "" for f in schema.fields}
    row.update(GOODS)
    row.update(
        submission_id=number, company_id=1, user_id=1, bill_date=date, total_amount="215.00",
        same_info=False, same_address=False,
    )
    row.update(fields)
    return tuple(row[f.name] for f in schema.fields)


def invoice(number, date="2024-05-01", **fields):
    base = {"bname": "Ann", "bphno1": "6000000001", "baddrState": "MH", "baddrPncd": "411001"}
    day = datetime.date.fromisoformat(date)
    return _row(INVOICE_SUBMISSION, number, day, {**base, **fields})


def quotation(number, date="2024-05-01", **fields):
    base = {"qname": "Ann", "phno1": "6000000001"}
    day = datetime.date.fromisoformat(date)
    return _row(QUOTATION_SUBMISSION, number, day, {**base, **fields})


def frame(spark, kind, rows):
    return spark.createDataFrame(
        rows, INVOICE_SUBMISSION if kind == INVOICE else QUOTATION_SUBMISSION
    )


COMPANY_COLUMNS = (
    "id long, name string, addrBnm string, addrBno string, addrFlno string, addrSt string, "
    "addrLoc string, addrDist string, addrState string, addrPncd string, phno1 string, "
    "phno2 string, email string, website string, gstin string, bnkAcnm string, bnkAcno string, "
    "bnkNm string, bnkIfsc string, custTerms string, created_by long"
)


def companies(spark):
    rows = [
        (i, f"Firm {i}", None, "1", None, "High St", "Loc", "Pune", "MH", "411001", "9000000001",
         None, None, None, None, None, None, None, None, "NET 30", 1)
        for i in (1, 2)
    ]
    return spark.createDataFrame(rows, COMPANY_COLUMNS)


def users(spark):
    return spark.createDataFrame(
        [(1, "owner", None, None, "admin", 1)],
        "id long, username string, email string, phno string, type string, company_id long",
    )

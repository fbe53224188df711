"""Which error each faulty document gets."""

import posts
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.text import INVOICE, QUOTATION
from ledgerloom.operators import validation

BAD_NUMBER = "Invalid values in qty or rate or gst"
BAD_LENGTH = (
    "All fields in the list of goods must have the same length and "
    "qty, rate, gst fields must be higher than their minimum values"
)


INVOICE_CASES = [
    ({}, None),
    ({"baddrSt": None}, "baddrSt not provided"),
    ({"eta": None, "sname": None, "qty": None}, "sname, qty, eta not provided"),
    ({"transport_mode": None, "total_amount": None}, "transport-mode, total-amount not provided"),
    ({"descp": []}, "descp not provided"),
    ({"descp": ["bolt", "  "]}, "descp not provided"),
    ({"qty": ["", "1"], "gst": ["0", " "]}, "qty, gst not provided"),
    ({"qty": ["abc", "1"]}, BAD_NUMBER),
    ({"rate": ["1d", "1"]}, BAD_NUMBER),
    ({"rate": ["inf", "1"]}, BAD_NUMBER),
    ({"qty": ["nan", "1"]}, BAD_LENGTH),
    ({"qty": ["0.0009", "1"]}, BAD_LENGTH),
    ({"qty": [" 0.001", "1e2"]}, None),
    ({"rate": ["0.009", "1"]}, BAD_LENGTH),
    ({"rate": ["0.01", "1"]}, None),
    ({"gst": ["-1", "0"]}, BAD_LENGTH),
    ({"gst": ["150", "0"]}, None),
    ({"uom": ["kg"]}, BAD_LENGTH),
    ({"baddrPncd": "060001"}, "Invalid Pincode"),
    ({"saddrPncd": "1"}, "Invalid Pincode"),
    ({"baddrPncd": " 411001 "}, None),
    ({"bphno2": "12345"}, "Invalid Phone Number"),
    ({"sphno1": "5000000001"}, "Invalid Phone Number"),
    ({"eta": "2024-02-30"}, "Invalid values in ETA"),
    ({"eta": "2024-2-3"}, None),
    ({"eta": "x", "bphno1": "1", "baddrPncd": "1", "qty": ["x", "1"]}, BAD_NUMBER),
    ({"eta": "x", "bphno1": "1", "baddrPncd": "1"}, "Invalid Pincode"),
    ({"bname": "", "bphno1": ""}, None),
    ({"qty": ["1e300", "1"]}, None),
    ({"qty": ["9999999999", "0.5"], "rate": ["1", "1"]}, None),
    ({"qty": ["1e300", "1"], "eta": "x"}, "Invalid values in ETA"),
    ({"gst": ["1e300", "1"]}, None),
]

QUOTATION_CASES = [
    ({}, None),
    ({"qname": None, "eta": None, "rate": []}, "qname, rate, eta not provided"),
    ({"phno1": "123"}, "Invalid mobile number"),
    ({"phno1": ""}, None),
    ({"eta": "2024-13-01"}, "Invalid values in ETA"),
    ({"gst": ["x", "1"], "phno1": "1"}, BAD_NUMBER),
]


@pytest.mark.parametrize("kind, cases", [(INVOICE, INVOICE_CASES), (QUOTATION, QUOTATION_CASES)])
def test_first_error(spark, kind, cases):
    make = posts.invoice if kind == INVOICE else posts.quotation
    rows = [make(i, **fields) for i, (fields, _) in enumerate(cases)]
    checked = validation.validate(posts.frame(spark, kind, rows), kind)
    got = {r.submission_id: (r.error_message, r.error_status) for r in checked.collect()}
    status = lambda e: None if e is None else 403
    assert got == {i: (e, status(e)) for i, (_, e) in enumerate(cases)}
    accepted = validation.accepted(checked).count()
    assert accepted + validation.rejects(checked).count() == len(rows)


def test_lines_of_accepted_documents(spark):
    df = posts.frame(spark, INVOICE, [posts.invoice(4, descp=[" bolt ", "nut"])])
    valid = validation.accepted(validation.validate(df, INVOICE)).withColumn(
        "id", F.col("submission_id")
    )
    rows = validation.explode_lines(valid).orderBy("line_no").collect()
    assert [(r.history_id, r.line_no, r.descp, r.hsn_sac, r.qty, r.rate, r.gst) for r in rows] == [
        (4, 1, "bolt", "h", 2.0, 100.0, 18.0),
        (4, 2, "nut", None, 1.5, 10.0, 0.0),
    ]


def test_step_warnings(spark):
    df = posts.frame(
        spark,
        INVOICE,
        [posts.invoice(1, qty=["2.5005", "1.001"], rate=["10.005", "x"], gst=["100.01", "0.125"])],
    )
    row = validation.step_warnings(df).first()
    assert (row.qty_off_step, row.rate_off_step, row.gst_off_step) == (1, 1, 2)


def test_ship_to_is_copied_where_asked(spark):
    rows = [
        posts.invoice(1, same_info=True, sname="X", saddrSt="own"),
        posts.invoice(2, same_address=True, sname="X", baddrSt="Road"),
    ]
    got = validation.default_ship_to(posts.frame(spark, INVOICE, rows)).orderBy("submission_id")
    first, second = got.collect()
    assert (first.sname, first.sphno1, first.saddrSt) == ("Ann", "6000000001", "own")
    assert (second.sname, second.saddrSt, second.saddrState) == ("X", "Road", "MH")

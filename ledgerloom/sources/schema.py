"""Schemas of the ledger tables and of submitted documents."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, DOUBLE = T.StringType(), T.LongType(), T.DoubleType()


def _struct(**groups) -> T.StructType:
    fields = []
    for names, kind in groups.values():
        fields += [T.StructField(name, kind) for name in names.split()]
    return T.StructType(fields)


ADDRESS = "addrBnm addrBno addrFlno addrSt addrLoc addrDist addrState addrPncd"

USERS = _struct(
    key=("id", LONG),
    text=("username email phno type", STRING),
    tenant=("company_id", LONG),
)
COMPANIES = _struct(
    key=("id", LONG),
    text=(
        f"name {ADDRESS} phno1 phno2 email website gstin bnkAcnm bnkAcno bnkNm bnkIfsc custTerms",
        STRING,
    ),
    by=("created_by", LONG),
)
DEFAULTS = _struct(text=("custTerms", STRING))
CLIENTS = _struct(
    key=("id", LONG),
    text=(f"name phno1 phno2 gstin {ADDRESS}", STRING),
    tenant=("company_id added_by", LONG),
    at=("added_at", T.TimestampType()),
)
GOODS = _struct(
    key=("id", LONG),
    text=("descp hsn_sac uom", STRING),
    price=("rate gst", DOUBLE),
    tenant=("company_id added_by", LONG),
    at=("added_at", T.TimestampType()),
)
HISTORY = _struct(
    key=("id bill_num", LONG),
    at=("bill_timestamp", T.TimestampType()),
    kind=("type", STRING),
    party=("billed_to shipped_to", LONG),
    info=("transport payment eta", STRING),
    amount=("amount", LONG),
    tenant=("company_id user_id", LONG),
)
# Lines also keep the tenant: goods ids are sequences of their company.
HISTORY_GOODS = _struct(
    key=("company_id history_id line_no goods_id", LONG), price=("qty amount", DOUBLE)
)

LEDGER_TABLES = {
    "users": USERS,
    "companies": COMPANIES,
    "defaults": DEFAULTS,
    "beneficiaries": CLIENTS,
    "goods": GOODS,
    "history": HISTORY,
    "history_goods": HISTORY_GOODS,
}

# Fields of the submitted forms, in the order they are checked.
PARTY_FIELDS = (
    "name",
    "phno1",
    "phno2",
    "gstin",
    "addrBnm",
    "addrBno",
    "addrFlno",
    "addrSt",
    "addrLoc",
    "addrDist",
    "addrState",
    "addrPncd",
)
GOODS_FIELDS = ("serialNumber", "descp", "hsn_sac", "qty", "uom", "rate", "amount", "gst")
INVOICE_INFO_FIELDS = ("transport_mode", "payment_mode", "eta")
COMPANY_REQUIRED = (
    "company_name",
    "addrBno",
    "addrSt",
    "addrLoc",
    "addrDist",
    "addrState",
    "addrPncd",
    "phno1",
)
COMPANY_OPTIONAL = (
    "addrBnm",
    "addrFlno",
    "phno2",
    "email",
    "website",
    "gstin",
    "bnkAcnm",
    "bnkAcno",
    "bnkNm",
    "bnkIfsc",
    "custTerms",
)

_DOCUMENT = [
    T.StructField("submission_id", LONG),
    T.StructField("company_id", LONG),
    T.StructField("user_id", LONG),
    T.StructField("bill_date", T.DateType()),
]
_LINES = [T.StructField(name, T.ArrayType(STRING)) for name in GOODS_FIELDS]


def _texts(names) -> list[T.StructField]:
    return [T.StructField(name, STRING) for name in names]


INVOICE_SUBMISSION = T.StructType(
    _DOCUMENT
    + _texts("b" + f for f in PARTY_FIELDS)
    + _texts("s" + f for f in PARTY_FIELDS)
    + _texts(INVOICE_INFO_FIELDS + ("total_amount",))
    + [T.StructField("same_info", T.BooleanType()), T.StructField("same_address", T.BooleanType())]
    + _LINES
)
QUOTATION_SUBMISSION = T.StructType(
    _DOCUMENT + _texts(("qname", "phno1", "eta", "total_amount")) + _LINES
)
# The text of a record that could not be read whole, carried to the rejects.
RESCUED = "rescued"
COMPANY_REGISTRATION = T.StructType(
    [T.StructField("arrival", LONG)]
    + _texts(COMPANY_REQUIRED + COMPANY_OPTIONAL)
    + [T.StructField("created_by", LONG)]
)
ACCOUNT_REGISTRATION = T.StructType(
    [T.StructField("arrival", LONG)] + _texts(("username", "email", "phno"))
)
# Where the printed document of a bill is found.
DOCUMENT_INDEX = _struct(
    key=("id company_id", LONG), label=("bill_label", STRING), place=("stretch", LONG)
)
# A change of one value of a stored row.
UPDATE = T.StructType(
    [
        T.StructField("entity", STRING),
        T.StructField("key", LONG),
        T.StructField("field", STRING),
        T.StructField("value", STRING),
        T.StructField("seq", LONG),
    ]
)

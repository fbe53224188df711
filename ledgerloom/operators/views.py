"""Reports over the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.functions.text import null_to_blank
from ledgerloom.operators.numbering import SERIES
from ledgerloom.operators.ranking import IdRanges, id_ranges, numbered

STAMP = "yyyy-MM-dd HH:mm:ss"
GOODS_ON = ["company_id", "descp"]


def tenant_scan(df: DataFrame, company_id: int) -> DataFrame:
    """Rows of one company; the filter reaches the Parquet scan."""
    return df.where(F.col("company_id") == company_id)


def of_type(bills: DataFrame, bill_type: str) -> DataFrame:
    return bills.where(F.col("type") == bill_type)


def newest_first(df: DataFrame) -> DataFrame:
    """Order of the ledger and inventory pages; a range-partitioned sort, not one task."""
    return df.orderBy(F.desc("id"))


def lookup(df: DataFrame, keys: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of the entities named by ``keys``, for all keys in one join."""
    return keys.join(df.select(key, *columns), key, "left")


def visible_bills(bills: DataFrame, users: DataFrame) -> DataFrame:
    """Bills every account may see: those of its own company."""
    viewers = users.where(F.col("company_id").isNotNull()).select(
        F.col("id").alias("viewer_id"), F.col("username").alias("viewer"), "company_id"
    )
    return bills.join(viewers, "company_id")


def bill_kind(bill_type: Column) -> Column:
    """Which of the two lists a bill is shown in; anything but an invoice is a quotation."""
    return F.when(bill_type == text.INVOICE, F.lit("invoice_list")).otherwise(
        F.lit("quotation_list")
    )


def route_by_type(bills: DataFrame) -> tuple[DataFrame, DataFrame]:
    is_invoice = F.coalesce(F.col("type") == text.INVOICE, F.lit(False))
    return bills.where(is_invoice), bills.where(~is_invoice)


def latest(bills: DataFrame, count: int = 5) -> DataFrame:
    """The newest bills per company and type, ranked before anything is joined to them."""
    newest = W.partitionBy(*SERIES).orderBy(F.desc("id"))
    return (
        bills.withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= count)
        .drop("_rank")
    )


def with_label(bills: DataFrame) -> DataFrame:
    return bills.withColumn(
        "bill_label",
        text.bill_label(F.col("type"), F.col("bill_timestamp"), F.col("bill_num")),
    )


def with_party_names(bills: DataFrame, clients: DataFrame) -> DataFrame:
    """Names of both parties; a bill whose party is unknown stays, with no name."""
    billed = clients.select(F.col("id").alias("billed_to"), F.col("name").alias("billed_name"))
    shipped = clients.select(F.col("id").alias("shipped_to"), F.col("name").alias("shipped_name"))
    return bills.join(billed, "billed_to", "left").join(shipped, "shipped_to", "left")


def header_view(bills: DataFrame, clients: DataFrame) -> DataFrame:
    """Bill headers as both ledger pages show them, with the amount if ``bills`` has it."""
    amount = [c for c in bills.columns if c == "amount"]
    return with_label(with_party_names(bills, clients)).select(
        "company_id",
        "id",
        "type",
        "bill_label",
        F.date_format("bill_timestamp", STAMP).alias("bill_timestamp"),
        null_to_blank(F.col("billed_name")).alias("billed_to"),
        null_to_blank(F.col("shipped_name")).alias("shipped_to"),
        null_to_blank(F.col("transport")).alias("transport"),
        null_to_blank(F.col("payment")).alias("payment"),
        null_to_blank(F.col("eta")).alias("eta"),
        *amount,
    )


def goods_lines(
    lines: DataFrame, goods: DataFrame, goods_on: list[str] = GOODS_ON
) -> DataFrame:
    """Lines with the goods they link to.

    Rate, tax and descriptions come from the goods table, that is from the first bill
    with the good; quantity and amount are those of the line.
    """
    master = goods.select(
        *goods_on,
        *[
            F.col(c).alias(f"good_{c}")
            for c in ("descp", "hsn_sac", "uom", "rate", "gst")
        ],
    )
    return (
        lines.select("history_id", "line_no", "qty", "amount", *goods_on)
        .join(master, goods_on, "left")
        .select(
            "history_id",
            "line_no",
            F.col("good_descp").alias("descp"),
            null_to_blank(F.col("good_hsn_sac")).alias("hsn_sac"),
            null_to_blank(F.col("good_uom")).alias("uom"),
            F.col("good_rate").alias("rate"),
            F.col("good_gst").alias("gst"),
            "qty",
            F.col("amount").alias("good_amount"),
        )
    )


def history_lines(headers: DataFrame, items: DataFrame) -> DataFrame:
    """One row per line; a bill without lines has one row without goods."""
    joined = headers.join(items, F.col("id") == F.col("history_id"), "left")
    return (
        joined.drop("history_id")
        .withColumn("hsn_sac", null_to_blank(F.col("hsn_sac")))
        .withColumn("uom", null_to_blank(F.col("uom")))
    )


LINE_STRUCT = ["line_no", "descp", "hsn_sac", "uom", "rate", "gst", "qty", "good_amount"]


def history_nested(
    headers: DataFrame, items: DataFrame, extra: tuple[Column, ...] = ()
) -> DataFrame:
    """One row per bill with its goods as an array in line order.

    Lines are nested before they meet the headers, so header texts are not repeated per
    line.  A bill without lines lists one entry with no values.  ``extra`` aggregates of
    the lines are computed on the way, after the shuffle: begun before it they would be of single
    lines and only make these wider.
    """
    nested = items.repartition("history_id").groupBy("history_id").agg(
        F.array_sort(F.collect_list(F.struct(*LINE_STRUCT))).alias("list_of_goods"), *extra
    )
    kinds = dict(items.dtypes)
    empty = F.struct(
        *[
            (F.lit("") if c in ("hsn_sac", "uom") else F.lit(None)).cast(kinds[c]).alias(c)
            for c in LINE_STRUCT
        ]
    )
    return (
        headers.join(nested, F.col("id") == F.col("history_id"), "left")
        .drop("history_id")
        .withColumn("list_of_goods", F.coalesce("list_of_goods", F.array(empty)))
    )


def flatten_goods(nested: DataFrame) -> DataFrame:
    """Nested bills with the array reduced to its size and a text."""
    line = lambda x: F.concat_ws(
        ":", x["line_no"].cast("string"), x["descp"], x["qty"].cast("string")
    )
    return nested.withColumn("n_goods", F.size("list_of_goods").cast("bigint")).withColumn(
        "list_of_goods", F.array_join(F.transform("list_of_goods", line), ";")
    )


def document_lookup(requests: DataFrame, bills: DataFrame) -> DataFrame:
    """Answer requests (id, company_id) for bill documents.

    A bill of another company is not found.
    """
    return document_answers(requests, with_label(bills))


def document_answers(requests: DataFrame, labelled: DataFrame) -> DataFrame:
    """The same from labels that are stored."""
    found = labelled.select("id", "company_id", "bill_label")
    return requests.join(found, ["id", "company_id"], "left").select(
        *requests.columns,
        F.when(F.col("bill_label").isNull(), F.lit(404)).otherwise(F.lit(200)).alias("status"),
        text.document_name(F.col("bill_label")).alias("file_name"),
        text.short_document_name(F.col("bill_label")).alias("link_text"),
        F.when(F.col("bill_label").isNull(), F.lit("PDF not found")).alias("error_message"),
    )


def bill_document(bills: DataFrame, bill_id: int, company_id: int) -> DataFrame:
    """One document by id, for its own company only."""
    return with_label(
        bills.where((F.col("id") == bill_id) & (F.col("company_id") == company_id))
    ).select("id", "company_id", text.document_name(F.col("bill_label")).alias("file_name"))


def inventory_goods(
    goods: DataFrame, users: DataFrame, ranges: IdRanges | None = None
) -> DataFrame:
    """Goods per company, newest first; goods added by unknown users are left out."""
    by = users.select(F.col("id").alias("added_by"), F.col("username").alias("added_by_name"))
    rows = goods.join(by, "added_by")
    ranges = ranges or id_ranges(goods, "id")
    ranked = numbered(
        rows, ["company_id"], ["id"], ranges.of(F.col("id")), "s_no", descending=True
    )
    return ranked.select(
        "company_id",
        "id",
        "s_no",
        "descp",
        null_to_blank(F.col("hsn_sac")).alias("hsn_sac"),
        null_to_blank(F.col("uom")).alias("uom"),
        text.inr(F.col("rate")).alias("rate_text"),
        text.percent(F.col("gst")).alias("gst_text"),
        "added_at",
        F.col("added_by_name").alias("added_by"),
    )


def inventory_clients(
    clients: DataFrame, users: DataFrame, ranges: IdRanges | None = None
) -> DataFrame:
    """Clients per company, newest first, with one-line address and phones."""
    by = users.select(F.col("id").alias("added_by"), F.col("username").alias("added_by_name"))
    ranges = ranges or id_ranges(clients, "id")
    ranked = numbered(
        clients.join(by, "added_by"),
        ["company_id"],
        ["id"],
        ranges.of(F.col("id")),
        "s_no",
        descending=True,
    )
    return ranked.select(
        "company_id",
        "id",
        "s_no",
        "name",
        text.address().alias("addr"),
        text.phones().alias("phno"),
        null_to_blank(F.col("gstin")).alias("gstin"),
        "added_at",
        F.col("added_by_name").alias("added_by"),
    )


def document_lines(priced: DataFrame) -> Column:
    """Printed lines of a bill, in order, for use in an aggregation."""
    return F.array_sort(
        F.collect_list(
            F.struct(
                "line_no",
                "descp",
                "hsn_sac",
                "qty",
                "uom",
                "rate_wo_gst",
                "amount_wo_gst",
                "gst",
                "gst_amount",
                "cgst_percent",
                "cgst_amount",
            )
        )
    )


def printed_line(line: Column, whole: Column) -> Column:
    """A document line with the taxes that apply: the whole one or two halves."""
    half = F.when(~whole, line["cgst_amount"])
    half_percent = F.when(~whole, line["cgst_percent"])
    return F.struct(
        *[
            line[c].alias(c)
            for c in (
                "line_no", "descp", "hsn_sac", "qty", "uom", "rate_wo_gst", "amount_wo_gst", "gst"
            )
        ],
        F.when(whole, line["gst_amount"]).alias("gst_amount"),
        half_percent.alias("cgst_percent"),
        half.alias("cgst_amount"),
        half_percent.alias("sgst_percent"),
        half.alias("sgst_amount"),
    )


# Company columns printed on a document, as document column: company column.
COMPANY_PRINT = {
    "company_email": "email",
    "company_website": "website",
    "company_gstin": "gstin",
    "bank_account_name": "bnkAcnm",
    "bank_account": "bnkAcno",
    "bank_name": "bnkNm",
    "bank_ifsc": "bnkIfsc",
    "terms": "custTerms",
}


def company_print(companies: DataFrame) -> DataFrame:
    return companies.select(
        F.col("id").alias("company_id"),
        F.col("name").alias("company_name"),
        text.address().alias("company_addr"),
        text.phones().alias("company_phno"),
        F.col("addrState").alias("company_state"),
        *[F.col(column).alias(name) for name, column in COMPANY_PRINT.items()],
    )


def issuer_print(users: DataFrame) -> DataFrame:
    return users.select(
        F.col("id").alias("user_id"),
        F.col("username").alias("issued_by"),
        F.col("type").alias("issued_by_role"),
    )


def party_print(clients: DataFrame, prefix: str) -> DataFrame:
    """Printed party columns of stored clients, keyed ``<prefix>id``."""
    return clients.select(
        F.col("id").alias(prefix + "id"),
        F.col("name").alias(prefix + "name"),
        text.address().alias(prefix + "addr"),
        text.phones().alias(prefix + "phno"),
        null_to_blank(F.col("gstin")).alias(prefix + "gstin"),
        F.col("addrState").alias(prefix + "state"),
    )


def print_columns(bills: DataFrame) -> DataFrame:
    """Add label, date and amount texts as issued."""
    kind, on = F.col("type"), F.col("bill_timestamp")
    return (
        bills.withColumn("issue_label", text.issue_label(kind, on, F.col("bill_num")))
        .withColumn("issue_date", text.issue_date_text(kind, on))
        .withColumn("grand_total_text", text.inr(F.col("grand_total")))
        .withColumn("total_amount_words", text.amount_words(F.col("grand_total")))
    )

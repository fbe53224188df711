"""The same helpers as SQL functions, for users who query with ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ledgerloom.functions.checks import JAVA_EMAIL, JAVA_PHONE, JAVA_PINCODE


def _quoted(pattern: str) -> str:
    return "r\"" + pattern + "\""


FUNCTIONS = {
    "inr(x DOUBLE) RETURNS STRING": "CASE WHEN x <> 0 THEN concat('₹', format_number(x, 2)) END",
    "is_valid_phno(s STRING) RETURNS BOOLEAN": f"s RLIKE {_quoted(JAVA_PHONE)}",
    "is_valid_pncd(s STRING) RETURNS BOOLEAN": f"s RLIKE {_quoted(JAVA_PINCODE)}",
    "is_valid_email(s STRING) RETURNS BOOLEAN": f"s RLIKE {_quoted(JAVA_EMAIL)}",
    "bill_label(kind STRING, at TIMESTAMP, num BIGINT) RETURNS STRING": (
        "concat(CASE WHEN kind = 'Invoice' THEN 'INV' ELSE 'EST' END, '-', "
        "CASE WHEN month(at) > 3 "
        "THEN concat(year(at) % 100, '/', year(at) % 100 + 1) "
        "ELSE concat(year(at) % 100 - 1, '/', year(at) % 100) END, "
        "format_string('-%02d-%06d', month(at), num))"
    ),
}


def register_sql_functions(spark: SparkSession) -> None:
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


# Reports over the ledger's bills as tables: a query names a company and gets its rows, and
# the company reaches the scan below.
TABLE_FUNCTIONS = {
    "tenant_bills(of_company BIGINT) "
    "RETURNS TABLE (id BIGINT, type STRING, bill_num BIGINT, bill_timestamp TIMESTAMP)": (
        "SELECT id, type, bill_num, bill_timestamp FROM {bills} WHERE company_id = of_company"
    ),
    "newest_bills(of_company BIGINT, up_to INT) "
    "RETURNS TABLE (id BIGINT, type STRING, bill_num BIGINT, place INT)": (
        "SELECT id, type, bill_num, place FROM ("
        "SELECT *, row_number() OVER (PARTITION BY type ORDER BY id DESC) AS place "
        "FROM {bills} WHERE company_id = of_company) WHERE place <= up_to"
    ),
    "next_number(of_company BIGINT, of_type STRING, on_day DATE) "
    "RETURNS TABLE (next_num BIGINT)": (
        "SELECT CASE WHEN newest IS NULL THEN 1 "
        "WHEN month(on_day) > 3 AND month(newest.bill_timestamp) < 4 THEN 1 "
        "ELSE newest.bill_num + 1 END FROM ("
        "SELECT type, max_by(CASE WHEN id IS NOT NULL THEN struct(bill_num, bill_timestamp) END, id) "
        "AS newest FROM (SELECT type, id, bill_num, bill_timestamp FROM {bills} "
        "WHERE company_id = of_company AND type = of_type "
        # A series without bills is there too.
        "UNION ALL SELECT of_type, NULL, NULL, NULL) GROUP BY type)"
    ),
}


def register_table_functions(spark: SparkSession, bills: str) -> None:
    """Register the functions over a table or view of numbered bills."""
    for signature, body in TABLE_FUNCTIONS.items():
        query = body.format(bills=bills)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {query}")

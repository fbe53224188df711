"""The ledger derived from the sample star-schema tables.

Each expression depends on one row only, so the mapping adds no shuffle of its own
except where lines of a bill are numbered.  Suppliers are the companies (tenants),
customers their clients, orders the bills, line items the bill lines.  One third of the
customers belong to company 0, which makes that tenant a hot key throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import py_round
from ledgerloom.functions.text import INVOICE, QUOTATION
from ledgerloom.operators.ranking import IdRanges, id_ranges
from ledgerloom.session import configure, size_shuffles

# Bill ids are time-ordered: the day, then the order key.
ID_DAY = 10**12
# Bills from this day on play the arriving batch where a query needs "stored" and "new".
CUTOFF = "1999-01-01"

UNKNOWN_USER = -1


def company_of(custkey: Column) -> Column:
    return F.when(custkey % 3 == 0, F.lit(0).cast("bigint")).otherwise(
        F.floor(custkey / 15).cast("bigint")
    )


def digits(key: Column, width: int) -> Column:
    return F.lpad(key.cast("string"), width, "0")


def supplier_phone(key: Column) -> Column:
    return F.concat(F.lit("9"), digits((key * 7919) % 1000000000, 9))


def customer_phone(key: Column) -> Column:
    """Blank for every seventh customer, out of the valid range for some others."""
    return F.when(key % 7 == 0, F.lit("")).otherwise(
        (F.lit(5000000000) + ((key % 1000003) * 7919000003) % 5000000000).cast("string")
    )


def customer_pincode(key: Column) -> Column:
    return digits((key % 1000003) * 104729 % 1000000, 6)


class SampleLedger:
    """Ledger tables as lazily built DataFrames over one folder of sample tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir
        self._ranges: IdRanges | None = None
        size_shuffles(spark, sf_dir)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def ranges(self) -> IdRanges:
        """Ranges of bill ids with about equal numbers of bills, counted once."""
        if self._ranges is None:
            self._ranges = id_ranges(self.headers().select("id"), "id")
        return self._ranges

    def places(self) -> DataFrame:
        """Nations with their regions: 25 rows at every scale."""
        nation, region = self.table("nation"), self.table("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            "n_nationkey", F.col("n_name").alias("dist"), F.col("r_name").alias("state")
        )

    def companies(self) -> DataFrame:
        k = F.col("s_suppkey")
        null = F.lit(None).cast("string")
        return (
            self.table("supplier")
            .join(self.places(), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                k.alias("id"),
                F.col("s_name").alias("name"),
                null.alias("addrBnm"),
                (k % 200 + 1).cast("string").alias("addrBno"),
                F.when(k % 3 == 0, F.concat(F.lit("Floor "), (k % 9).cast("string"))).alias(
                    "addrFlno"
                ),
                F.concat(F.lit("Street "), (k % 40).cast("string")).alias("addrSt"),
                F.concat(F.lit("Locality "), (k % 25).cast("string")).alias("addrLoc"),
                F.col("dist").alias("addrDist"),
                F.col("state").alias("addrState"),
                digits(100000 + (k % 1000003) * 104729 % 900000, 6).alias("addrPncd"),
                supplier_phone(k).alias("phno1"),
                F.when(k % 4 == 0, supplier_phone(k + 1)).alias("phno2"),
                F.when(k % 5 != 0, F.concat(F.lit("s"), k.cast("string"), F.lit("@example.com")))
                .alias("email"),
                F.when(k % 2 == 0, F.concat(F.lit("www.s"), k.cast("string"), F.lit(".example")))
                .alias("website"),
                F.when(k % 3 != 0, F.concat(F.lit("S"), digits(k, 14))).alias("gstin"),
                F.col("s_name").alias("bnkAcnm"),
                F.when(k % 6 != 0, digits(k * 37, 12)).alias("bnkAcno"),
                F.concat(F.lit("Bank "), (k % 9).cast("string")).alias("bnkNm"),
                F.concat(F.lit("BANK0"), digits(k % 1000000, 6)).alias("bnkIfsc"),
                F.when(k % 2 == 0, F.lit("NET 30")).alias("custTerms"),
                k.alias("created_by"),
            )
        )

    def users(self) -> DataFrame:
        """One account per company; no credentials."""
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            k.alias("id"),
            F.col("s_name").alias("username"),
            F.when(k % 5 != 0, F.concat(F.lit("u"), k.cast("string"), F.lit("@example.com")))
            .alias("email"),
            F.when(k % 3 != 0, supplier_phone(k)).alias("phno"),
            F.lit("admin").alias("type"),
            F.when(k % 10 != 9, k).alias("company_id"),
        )

    def defaults(self) -> DataFrame:
        """Default terms: those of the company with the smallest id that has any."""
        return self.table("supplier").agg(
            F.min(F.when(F.col("s_suppkey") % 2 == 0, F.lit("NET 30"))).alias("custTerms")
        )

    def clients(self) -> DataFrame:
        k = F.col("c_custkey")
        null = F.lit(None).cast("string")
        return (
            self.table("customer")
            .join(self.places(), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                k.alias("id"),
                F.col("c_name").alias("name"),
                F.nullif(customer_phone(k), F.lit("")).alias("phno1"),
                F.when(k % 5 == 0, supplier_phone(k)).alias("phno2"),
                F.when(k % 4 != 0, F.concat(F.lit("C"), digits(k, 14))).alias("gstin"),
                null.alias("addrBnm"),
                (k % 500 + 1).cast("string").alias("addrBno"),
                F.when(k % 6 == 0, F.concat(F.lit("Floor "), (k % 7).cast("string"))).alias(
                    "addrFlno"
                ),
                F.concat(F.lit("Street "), (k % 50).cast("string")).alias("addrSt"),
                F.col("c_mktsegment").alias("addrLoc"),
                F.col("dist").alias("addrDist"),
                F.col("state").alias("addrState"),
                customer_pincode(k).alias("addrPncd"),
                company_of(k).alias("company_id"),
                F.when(k % 17 == 0, F.lit(UNKNOWN_USER).cast("bigint"))
                .otherwise(company_of(k))
                .alias("added_by"),
                F.concat(
                    F.date_format(
                        F.date_add(F.lit("1995-01-01").cast("date"), (k % 365).cast("int")),
                        "yyyy-MM-dd",
                    ),
                    F.lit(" 00:00:00"),
                ).alias("added_at"),
            )
        )

    def headers(self, kind: str | None = None) -> DataFrame:
        """Bills, of one kind if asked for, without number and amount.

        ``order_key`` and ``custkey`` belong to this mapping, not to the ledger: they
        link a bill to its lines and to the customer who caused it.
        """
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        is_invoice = F.col("o_orderstatus").isin("F", "O")
        day = F.col("o_orderdate").cast("date")
        blank = F.lit("")
        orders = self.table("orders")
        if kind == INVOICE:
            orders = orders.where(is_invoice)
        elif kind == QUOTATION:
            orders = orders.where(~is_invoice | F.col("o_orderstatus").isNull())
        return orders.select(
            (F.datediff(day, F.lit("1990-01-01").cast("date")) * F.lit(ID_DAY) + k).alias("id"),
            k.alias("order_key"),
            c.alias("custkey"),
            company_of(c).alias("company_id"),
            F.when(k % 13 == 0, F.lit(UNKNOWN_USER).cast("bigint"))
            .otherwise(company_of(c))
            .alias("user_id"),
            F.when(is_invoice, F.lit(INVOICE)).otherwise(F.lit(QUOTATION)).alias("type"),
            F.col("o_orderdate").cast("timestamp").alias("bill_timestamp"),
            F.when(k % 19 != 0, c).alias("billed_to"),
            F.when(is_invoice, F.when(k % 4 == 1, c + 1).when(k % 4 != 0, c)).alias("shipped_to"),
            F.when(is_invoice, F.col("o_orderpriority")).alias("transport"),
            F.when(is_invoice, F.when(k % 3 == 0, blank).when(k % 3 == 1, F.lit("CASH"))
                   .otherwise(F.lit("UPI"))).alias("payment"),
            F.when(k % 5 == 0, blank)
            .otherwise(F.date_format(F.date_add(day, 7), "dd-MM-yyyy"))
            .alias("eta"),
        )

    def lines(
        self, headers: DataFrame, goods: bool = False, line_no: bool = False
    ) -> DataFrame:
        """Lines of the given bills.

        ``goods`` adds the description columns (a join with parts), ``line_no`` the
        position inside the bill (a sort within the bill).
        """
        bills = headers.select(
            F.col("order_key"), F.col("id").alias("history_id"), "company_id", "user_id"
        )
        items = self.table("lineitem")
        lines = items.join(bills, items.l_orderkey == bills.order_key)
        if line_no:
            within_bill = W.partitionBy("l_orderkey").orderBy(
                "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
            )
            lines = lines.withColumn("line_no", F.row_number().over(within_bill).cast("bigint"))
        columns = [
            "history_id",
            "company_id",
            "user_id",
            F.col("l_quantity").alias("qty"),
            py_round(F.col("l_extendedprice") / F.col("l_quantity")).alias("rate"),
            F.rint(F.col("l_tax") * 100).alias("gst"),
        ]
        if line_no:
            columns.append("line_no")
        if goods:
            part = self.table("part")
            lines = lines.join(part, F.col("l_partkey") == part.p_partkey)
            columns += [
                F.col("p_name").alias("descp"),
                F.col("p_brand").alias("hsn_sac"),
                F.col("p_type").alias("uom"),
            ]
        return lines.select(*columns).withColumn("amount", F.col("rate") * F.col("qty"))

    def submission_headers(self, kind: str) -> DataFrame:
        """Posted documents without their lines, all fields strings.

        ``order_key`` modulo 97 picks one fault; most of its values leave the document
        alone.
        """
        d = F.col("order_key") % 97
        clients = self.clients().drop("company_id", "added_by", "added_at")
        party = {c: F.coalesce(F.col(c), F.lit("")) for c in clients.columns if c != "id"}
        blank = F.lit("")
        party["name"] = (
            F.when(d == 18, blank)
            .when(d == 19, F.concat(F.lit(" "), party["name"], F.lit(" ")))
            .otherwise(party["name"])
        )
        party["phno1"] = (
            F.when(d == 18, blank).when(d == 16, F.lit("123")).otherwise(party["phno1"])
        )
        party["phno2"] = F.when(d == 14, F.lit("12345")).otherwise(party["phno2"])
        party["addrPncd"] = F.when(d == 13, F.lit("060001")).otherwise(party["addrPncd"])
        party["addrState"] = F.when(d == 17, blank).otherwise(party["addrState"])
        absent = F.lit(None).cast("string")
        eta = (
            F.when(d == 2, absent)
            .when(d == 15, F.lit("2024-02-30"))
            .when(d == 16, F.lit("2024-13-01"))
            .when(F.col("order_key") % 5 == 0, blank)
            .otherwise(F.date_format(F.date_add("bill_date", 7), "yyyy-MM-dd"))
        )
        documents = (
            self.headers(kind)
            .drop("eta", "billed_to", "shipped_to")
            .withColumn("bill_date", F.col("bill_timestamp").cast("date"))
            .join(clients.withColumnRenamed("id", "custkey"), "custkey")
        )
        common = [F.col("id").alias("submission_id"), "order_key", "company_id", "user_id",
                  "bill_date", eta.alias("eta"), F.lit("0.00").alias("total_amount")]
        if kind == QUOTATION:
            return documents.select(
                *common,
                party["name"].alias("qname"),
                F.when(d == 1, absent).otherwise(party["phno1"]).alias("phno1"),
            )

        billing = dict(party)
        billing["addrSt"] = F.when(d == 1, absent).otherwise(party["addrSt"])
        # One bill in four ships to another party, half of them ship to the buyer.
        other = F.col("order_key") % 4 == 1
        same = F.col("order_key") % 4 >= 2
        shipping = {c: blank for c in party}
        shipping["name"] = F.when(other, F.concat(F.lit("Ship "), party["name"])).otherwise(blank)
        shipping["phno1"] = F.when(other, F.coalesce("phno1", blank)).otherwise(blank)
        shipping["gstin"] = F.when(other, F.lit("GSTIN")).otherwise(blank)
        return documents.select(
            *common,
            *[value.alias("b" + name) for name, value in billing.items()],
            *[value.alias("s" + name) for name, value in shipping.items()],
            F.col("transport").alias("transport_mode"),
            F.col("payment").alias("payment_mode"),
            same.alias("same_info"),
            same.alias("same_address"),
        )

    def submissions(self, kind: str) -> DataFrame:
        """Posted documents with their repeated goods fields as parallel arrays."""
        headers = self.headers(kind)
        d = F.col("order_key") % 97
        first = F.col("line_no") == 1

        def damaged(value: Column, **faults: str) -> Column:
            for number, text in faults.items():
                value = F.when(first & (d == int(number[1:])), F.lit(text)).otherwise(value)
            return value

        def two_decimals(value: Column) -> Column:
            return F.call_function("format_number", value, F.lit("0.00"))

        line = F.struct(
            "line_no",
            F.when(first & (d == 19), F.concat(F.lit("  "), "descp", F.lit("\t")))
            .otherwise(damaged(F.col("descp"), d3=""))
            .alias("descp"),
            "hsn_sac",
            damaged(
                F.col("qty").cast("string"),
                d4="abc", d5="0.0009", d8="nan", d10="1d", d11="1e2", d20="2.5005",
            ).alias("qty"),
            "uom",
            damaged(
                two_decimals(F.col("rate")),
                d6="0.009", d9="inf", d16="", d22="1_0", d23="10.005",
            ).alias("rate"),
            F.when(F.col("order_key") % 29 == 0, F.lit("1.00"))
            .otherwise(two_decimals(F.col("amount")))
            .alias("amount"),
            damaged(F.col("gst").cast("string"), d7="-1", d21="150", d24="").alias("gst"),
        )
        lines = (
            # Lines come from a join by part: they are shuffled as they are and posted after it.
            self.lines(headers, goods=True, line_no=True)
            .repartition("history_id")
            .withColumn("order_key", F.col("history_id") % ID_DAY)
            .groupBy("history_id")
            .agg(F.array_sort(F.collect_list(line)).alias("lines"))
        )
        shortened = F.slice("lines.hsn_sac", 2, F.greatest(F.size("lines") - 1, F.lit(0)))
        documents = self.submission_headers(kind)
        return documents.join(
            lines, documents.submission_id == lines.history_id, "left"
        ).select(
            *documents.columns,
            F.col("lines.line_no").cast("array<string>").alias("serialNumber"),
            F.col("lines.descp").alias("descp"),
            F.when(d == 12, shortened).otherwise(F.col("lines.hsn_sac")).alias("hsn_sac"),
            *[F.col(f"lines.{c}").alias(c) for c in ("qty", "uom", "rate", "amount", "gst")],
        )

    def company_registrations(self) -> DataFrame:
        """One registration per customer, many of them clashing.

        Every third registration posts the same GSTIN; others repeat a value of their
        predecessor or of a stored company.
        """
        k = F.col("c_custkey")
        blank = F.lit("")
        stored = F.floor(k / 15).cast("bigint")

        def own_phone(key: Column) -> Column:
            return F.concat(F.lit("8"), digits(key % 1000000007, 9))

        def mail(key: Column) -> Column:
            return F.concat(F.lit("r"), key.cast("string"), F.lit("@example.com"))

        return self.table("customer").select(
            k.alias("arrival"),
            F.when(k % 41 == 7, F.lit("  ")).otherwise(F.col("c_name")).alias("company_name"),
            (k % 90 + 1).cast("string").alias("addrBno"),
            F.concat(F.lit("Street "), (k % 30).cast("string")).alias("addrSt"),
            F.col("c_mktsegment").alias("addrLoc"),
            F.lit("District").alias("addrDist"),
            F.when(k % 59 == 8, blank).otherwise(F.lit("State")).alias("addrState"),
            F.when(k % 47 == 9, F.lit("012345")).otherwise(F.lit("560001")).alias("addrPncd"),
            F.when(k % 31 == 10, F.lit("12345"))
            .when(k % 25 == 3, supplier_phone(stored))
            .when(k % 10 == 1, own_phone(k - 1))
            .otherwise(own_phone(k))
            .alias("phno1"),
            blank.alias("addrBnm"),
            blank.alias("addrFlno"),
            F.when(k % 43 == 11, F.lit("5")).otherwise(blank).alias("phno2"),
            F.when(k % 37 == 12, F.lit("not a mail"))
            .when(k % 6 == 0, blank)
            .when(k % 14 == 2, mail(k - 1))
            .otherwise(mail(k))
            .alias("email"),
            F.when(k % 53 != 13, blank).alias("website"),
            F.when(k % 45 == 4, F.concat(F.lit("S"), digits(stored, 14)))
            .when(k % 3 == 1, F.lit("C00000000000000"))
            .when(k % 4 == 0, blank)
            .otherwise(F.concat(F.lit("C"), digits(k, 14)))
            .alias("gstin"),
            F.col("c_name").alias("bnkAcnm"),
            F.when(k % 8 == 0, blank)
            .when(k % 22 == 5, digits(k - 1, 12))
            .otherwise(digits(k, 12))
            .alias("bnkAcno"),
            F.lit("Bank").alias("bnkNm"),
            F.when(k % 9 == 0, F.lit("SHORT")).otherwise(F.lit("BANK0000001")).alias("bnkIfsc"),
            blank.alias("custTerms"),
            k.alias("created_by"),
        )

    def account_registrations(self) -> DataFrame:
        """One account per customer; every third one posts the same e-mail."""
        k = F.col("c_custkey")
        blank = F.lit("")
        stored = F.floor(k / 15).cast("bigint")
        return self.table("customer").select(
            k.alias("arrival"),
            F.when(k % 29 == 3, F.lit("abc"))
            .when(k % 17 == 4, F.concat(F.lit("user"), (k - 1).cast("string")))
            .when(k % 33 == 5, F.concat(F.lit("Supplier#"), digits(stored, 9)))
            .otherwise(F.concat(F.lit("user"), k.cast("string")))
            .alias("username"),
            F.when(k % 37 == 6, F.lit("bad@mail"))
            .when(k % 3 == 1, F.lit(" info@example.com "))
            .when(k % 8 == 0, blank)
            .otherwise(F.concat(F.lit("a"), k.cast("string"), F.lit("@example.com")))
            .alias("email"),
            F.when(k % 53 == 7, F.lit(None).cast("string"))
            .when(k % 11 == 0, blank)
            .when(k % 13 == 2, F.lit("123"))
            .when(k % 19 == 9, supplier_phone(stored))
            .otherwise(F.concat(F.lit("7"), digits(F.floor(k / 2).cast("bigint"), 9)))
            .alias("phno"),
        )

    def terms_updates(self) -> DataFrame:
        """A stream of terms changes; company 0 receives a third of them."""
        k = F.col("c_custkey")
        return self.table("customer").select(
            k.alias("seq"),
            F.when(k % 23 != 0, company_of(k)).alias("id"),
            F.when(k % 5 == 0, F.lit(""))
            .otherwise(F.concat(F.lit("NET "), (k % 60 + 1).cast("string")))
            .alias("custTerms"),
        )

    def document_requests(self) -> DataFrame:
        """One request per bill; every fifth asks on behalf of another company."""
        asked = self.headers()
        wrong = F.col("company_id") + 1
        return asked.select(
            "id",
            F.when(F.col("order_key") % 5 == 0, wrong)
            .otherwise(F.col("company_id"))
            .alias("company_id"),
        )

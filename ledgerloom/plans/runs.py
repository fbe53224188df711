"""From submitted documents to ledger rows."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.functions.text import INVOICE, QUOTATION
from ledgerloom.operators import dims, numbering, pricing, validation, views
from ledgerloom.operators.ranking import id_ranges
from ledgerloom.session import shared_dir
from ledgerloom.sources import ledger
from ledgerloom.sources.schema import PARTY_FIELDS, RESCUED


# Repeated fields a run needs after validation; numbers are kept parsed.
LINE_ARRAYS = (
    "descp",
    "hsn_sac",
    "uom",
    "amount",
    *(validation.numbers_of(f) for f in validation.LINE_MINIMA),
)


@dataclass(frozen=True)
class Run:
    """Everything a batch of one kind of document adds to the ledger."""

    bills: DataFrame
    lines: DataFrame
    clients: DataFrame
    goods: DataFrame
    rejects: DataFrame
    scratch: str


def materialise(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write once and read back, so that several consumers share one computation."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_submissions(submissions: DataFrame, kind: str) -> DataFrame:
    """Validated documents with unified party columns.

    Submission ids follow arrival and become the bill ids; ``refuse_repeated`` makes them
    unique.
    """
    if kind == INVOICE:
        submissions = validation.default_ship_to(submissions)
    checked = validation.blank_parties(validation.validate(submissions, kind), kind)
    keep = [
        "submission_id",
        "company_id",
        "user_id",
        "bill_date",
        *["b" + f for f in PARTY_FIELDS],
        *["s" + f for f in PARTY_FIELDS],
        "transport_mode",
        "payment_mode",
        "eta",
        *LINE_ARRAYS,
        "error_message",
        "error_status",
    ]
    if RESCUED in submissions.columns:
        keep.append(RESCUED)
        checked = validation.refuse_unreadable(checked)
    return checked.select(*keep)


def price_bills(valid: DataFrame, priced: DataFrame, companies: DataFrame, kind: str) -> DataFrame:
    """Headers with totals and taxes; a quotation never splits its tax."""
    posted_ok = pricing.posted_amount_matches(F.col("posted_amount"), F.col("amount"))
    totals = pricing.sum_lines(
        priced,
        extra=(
            F.count("*").alias("n_lines"),
            F.sum(F.when(posted_ok, 0).otherwise(1)).alias("posted_mismatches"),
        ),
    ).drop("company_id")
    sellers = companies.select(
        F.col("id").alias("company_id"), F.col("addrState").alias("company_state")
    )
    bills = (
        valid.join(sellers, "company_id", "left")
        .join(totals, F.col("id") == F.col("history_id"))
        .drop("history_id")
    )
    if kind == QUOTATION:
        return bills.withColumn("total_gst_amount", F.col("sum_gst"))
    return pricing.split_tax(
        bills.withColumn("inter_state", pricing.crosses_states("company_state", "baddrState"))
    )


def run_batch(
    submissions: DataFrame,
    kind: str,
    companies: DataFrame,
    clients: DataFrame | None = None,
    goods: DataFrame | None = None,
    seeds: DataFrame | None = None,
    stored_bills: DataFrame | None = None,
) -> Run:
    """Validate, price, number and resolve a batch against the stored ledger, if any.

    Every submission ends up in the bills or in the rejects, once.  The documents are read
    twice after validation, for their lines and for everything else; both are written
    narrow, and all that follows is derived from those two, so the documents are removed then.
    """
    scratch = shared_dir(submissions.sparkSession, "run")
    arrived = checked_submissions(submissions, kind).withColumn(
        "_row", F.monotonically_increasing_id()
    )
    arrived = materialise(arrived, scratch, "submissions")
    repeated = materialise(
        validation.repeated_ids(arrived, "_row", stored_bills), scratch, "repeated"
    )
    checked = validation.refuse_repeated(arrived, "_row", repeated=repeated)
    documents_ = checked.withColumn("id", F.col("submission_id"))
    priced = materialise(
        pricing.price_lines(validation.explode_lines(validation.accepted(documents_))),
        scratch,
        "lines",
    )
    headers = materialise(documents_.drop(*LINE_ARRAYS, "_row"), scratch, "headers")
    ledger.delete_path(submissions.sparkSession, f"{scratch}/submissions")
    valid = (
        validation.accepted(headers)
        .drop(RESCUED)
        .withColumn("type", F.lit(kind))
        .withColumn("bill_timestamp", F.col("bill_date").cast("timestamp"))
        .withColumn("eta", text.eta_text(F.col("eta")))
    )
    ranges = id_ranges(valid, "id")
    priced_bills = price_bills(valid, priced, companies, kind)
    numbers = numbering.number_bills(
        valid.select("company_id", "type", "id", "bill_timestamp"), seeds, ranges
    ).select("id", "bill_num")
    first_seen = valid.select(
        F.col("id").alias("first_bill"),
        F.col("bill_timestamp").alias("added_at"),
    )

    attributes = list(PARTY_FIELDS) if kind == INVOICE else ["name", "phno1"]
    mentions = dims.party_mentions(valid, attributes)
    new_parties = (
        dims.first_parties(mentions) if clients is None else dims.new_clients(mentions, clients)
    )
    new_parties = dims.with_ids(new_parties, ["first_bill", "first_role"], clients, ranges)
    new_parties = materialise(new_parties.join(first_seen, "first_bill"), scratch, "clients")
    parties = dims.party_ids(mentions, clients, new_parties)
    bills = dims.with_parties(priced_bills.join(numbers, "id"), parties)

    fresh = dims.first_goods(priced) if goods is None else dims.new_goods(priced, goods)
    fresh = dims.with_ids(fresh, ["first_bill", "first_line"], goods, ranges)
    fresh = materialise(fresh.join(first_seen, "first_bill"), scratch, "goods")
    known = fresh.select(*dims.GOODS_KEY, "id")
    if goods is not None:
        stored = goods.select(*dims.GOODS_KEY, "id")
        known = known.unionByName(dims.known_rows(stored, priced, dims.GOODS_KEY))
    linked = dims.link_goods(priced, known)

    printed = views.print_columns(bills).withColumn(
        "amount", F.col("grand_total")
    )
    return Run(
        views.with_label(printed), linked, new_parties, fresh, validation.rejects(headers), scratch
    )


def release(run: Run) -> None:
    """Remove the intermediate tables of a run whose results have been written."""
    ledger.delete_path(run.bills.sparkSession, run.scratch)


def documents(run: Run, companies: DataFrame, users: DataFrame) -> DataFrame:
    """What is printed on each document of a run, with its lines as an array.

    Lines of a bill inside one state show both half taxes, all others the whole tax.
    """
    whole = F.col("inter_state") if "inter_state" in run.bills.columns else F.lit(True)
    lines = run.lines.repartition("history_id").groupBy("history_id").agg(
        views.document_lines(run.lines).alias("lines")
    )
    return (
        run.bills.join(views.company_print(companies).drop("company_state"), "company_id", "left")
        .join(views.issuer_print(users), "user_id", "left")
        .join(lines, F.col("id") == F.col("history_id"))
        .withColumn("lines", F.transform("lines", lambda x: views.printed_line(x, whole)))
        .withColumn("buyer_addr", text.address("b"))
        .withColumn("buyer_phno", text.phones("b"))
        .withColumn("ship_addr", text.address("s"))
        .withColumn("ship_phno", text.phones("s"))
        .drop("history_id", "error_message", "error_status")
    )


def append_run(
    run: Run,
    folder: str,
    batch_id: int,
    companies: DataFrame | None = None,
    users: DataFrame | None = None,
    stretch: int | None = None,
) -> Run:
    """Append a run to the ledger: dimensions first, lines, then headers, sinks, the marker.

    With a ``stretch``, the number of ids in a folder, an index of documents is kept as well.

    Readers see the batch only when its marker is written, after everything else, and each
    batch owns its files, so repeating a failed batch replaces what it left behind.  Bills and
    lines are worked out once, into the scratch folder, and go to all sinks from there; the run
    that is returned reads them there as well.
    """
    run = replace(
        run,
        bills=materialise(run.bills, run.scratch, "bills"),
        lines=materialise(run.lines, run.scratch, "linked"),
    )
    spark = run.bills.sparkSession
    ledger.begin_batch(spark, folder, batch_id)
    ledger.append_table(run.goods, folder, "goods", batch_id)
    ledger.append_table(run.clients, folder, "beneficiaries", batch_id)
    lines = run.lines.select("company_id", "history_id", "line_no", "goods_id", "qty", "amount")
    ledger.append_table(lines, folder, "history_goods", batch_id)
    bills = run.bills.withColumnsRenamed({"transport_mode": "transport", "payment_mode": "payment"})
    ledger.append_table(bills, folder, "history", batch_id)
    ledger.append_rejects(run.rejects, folder, batch_id)
    if stretch:
        ledger.append_document_index(run.bills, folder, batch_id, stretch)
    if companies is not None and users is not None:
        ledger.append_documents(documents(run, companies, users), folder, batch_id)
    ledger.publish_batch(spark, folder, batch_id)
    return run

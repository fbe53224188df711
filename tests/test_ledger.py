"""Batch runs, sinks and reads of a stored ledger."""

import gzip
from pathlib import Path

import posts
import pytest
from compare import SF_SMALL
from pyspark.sql import functions as F

from ledgerloom.functions.text import INVOICE, QUOTATION
from ledgerloom.operators import views
from ledgerloom.plans import queries, runs
from ledgerloom.session import shared_dir
from ledgerloom.sources import ledger
from ledgerloom.streaming import ingest


def rows_of(folder, name, spark, *columns):
    return sorted(tuple(r) for r in ledger.read_table(spark, folder, name).select(*columns).collect())


@pytest.fixture(scope="module")
def stored(spark):
    """Three batches: invoices, more invoices, quotations."""
    folder = shared_dir(spark, "test-ledger")
    batches = [
        (
            INVOICE,
            0,
            [
                posts.invoice(1, "2024-03-30", same_info=True),
                posts.invoice(2, "2024-03-31", sname="Bob", sphno1="6000000002"),
                posts.invoice(3, "2024-04-01", bname="Cy", bphno1="", baddrState="GJ"),
                posts.invoice(4, "2024-04-01", qty=["x", "1"]),
            ],
        ),
        (
            INVOICE,
            1,
            [
                posts.invoice(5, "2024-04-02", bname="Cy", bphno1="", descp=["nut", "rod"]),
                posts.invoice(6, "2024-04-02", company_id=2, bname=""),
            ],
        ),
        (QUOTATION, 0, [posts.quotation(7, eta="2024-06-01"), posts.quotation(8, qname="New")]),
    ]
    for kind, number, rows in batches:
        ingest.ingest_batch(
            posts.frame(spark, kind, rows), kind, folder, number,
            posts.companies(spark), posts.users(spark),
        )
    return folder, batches


def test_headers(spark, stored):
    got = rows_of(stored[0], "history", spark, "id", "type", "bill_num", "billed_to",
                  "shipped_to", "amount", "eta")
    assert got == [
        (1, "Invoice", 1, 1, 1, 215, ""),
        (2, "Invoice", 2, 1, 2, 215, ""),
        (3, "Invoice", 1, 3, None, 215, ""),
        (5, "Invoice", 2, 4, None, 215, ""),
        (6, "Invoice", 1, None, None, 215, ""),
        (7, "Quotation", 1, 1, None, 215, "01-06-2024"),
        (8, "Quotation", 2, 5, None, 215, ""),
    ]


def test_dimensions(spark, stored):
    assert rows_of(stored[0], "goods", spark, "company_id", "id", "descp", "rate", "hsn_sac") == [
        (1, 1, "bolt", 100.0, "h"), (1, 2, "nut", 10.0, None), (1, 3, "rod", 10.0, None),
        (2, 1, "bolt", 100.0, "h"), (2, 2, "nut", 10.0, None),
    ]
    assert rows_of(stored[0], "beneficiaries", spark, "company_id", "id", "name",
                   F.coalesce("phno1", F.lit("-"))) == [
        (1, 1, "Ann", "6000000001"), (1, 2, "Bob", "6000000002"), (1, 3, "Cy", "-"),
        (1, 4, "Cy", "-"), (1, 5, "New", "6000000001"),
    ]


def test_lines_and_rejects(spark, stored):
    folder = stored[0]
    lines = rows_of(folder, "history_goods", spark, "history_id", "line_no", "goods_id", "qty",
                    "amount")
    assert lines[:2] == [(1, 1, 1, 2.0, 200.0), (1, 2, 2, 1.5, 15.0)]
    assert [(l[0], l[2]) for l in lines if l[0] == 5] == [(5, 2), (5, 3)]
    rejects = spark.read.parquet(f"{folder}/rejects").select("submission_id", "error_status")
    assert [tuple(r) for r in rejects.collect()] == [(4, 403)]


def test_documents(spark, stored):
    docs = {r.id: r for r in spark.read.json(f"{stored[0]}/documents").collect()}
    one, three = docs[1], docs[3]
    assert (one.issue_label, one.issue_date) == ("INV-23/24-03-000001", "30-03-2024")
    assert one.company_addr == "1 High St Loc Pune 411001 MH" and one.issued_by == "owner"
    assert (one.total_cgst_amount, one.total_sgst_amount) == (18.0, 18.0)
    assert three.total_gst_amount == 36.0 and three.total_cgst_amount is None
    assert one.grand_total_text == "₹215.00"
    assert one.total_amount_words == "Two Hundred And Fifteen Rupees, Zero Paise Only"
    assert [(l.line_no, l.descp, l.amount_wo_gst) for l in one.lines] == [
        (1, "bolt", 164.0), (2, "nut", 15.0)
    ]
    assert [(l.gst_amount, l.cgst_amount, l.sgst_percent) for l in one.lines][0] == (None, 18.0, 9.0)
    assert [(l.gst_amount, l.cgst_amount) for l in three.lines][0] == (36.0, None)
    assert docs[7].lines[0].gst_amount == 36.0 and docs[7].total_gst_amount == 36.0
    assert docs[7].issue_date == "01/05/2024"


def test_repeating_a_batch_changes_nothing(spark, stored):
    folder, batches = stored
    before = {t: rows_of(folder, t, spark, "*") for t in ("history_goods",)}
    headers = rows_of(folder, "history", spark, "id", "bill_num", "billed_to")
    kind, number, rows = batches[-1]
    ingest.ingest_batch(
        posts.frame(spark, kind, rows), kind, folder, number,
        posts.companies(spark), posts.users(spark),
    )
    assert rows_of(folder, "history", spark, "id", "bill_num", "billed_to") == headers
    assert {t: rows_of(folder, t, spark, "*") for t in ("history_goods",)} == before


def test_a_batch_that_failed_half_way_is_repaired(spark, monkeypatch):
    """Lost between lines and headers, the batch is run again and leaves no trace."""
    broken, clean = shared_dir(spark, "test-broken"), shared_dir(spark, "test-clean")
    first = [posts.invoice(1), posts.invoice(2, bname="Bob", bphno1="", descp=["rod", "nut"])]
    second = [posts.invoice(3, descp=["cap", "rod"]), posts.invoice(4, bname="Cy", bphno1="")]

    def batch(folder, number, rows):
        ingest.ingest_batch(
            posts.frame(spark, INVOICE, rows), INVOICE, folder, number, posts.companies(spark)
        )

    append = ledger.append_table

    def lost(df, folder, name, batch_id):
        if name == "history":
            raise RuntimeError("executor lost")
        append(df, folder, name, batch_id)

    for folder in (broken, clean):
        batch(folder, 0, first)
    with monkeypatch.context() as patch:
        patch.setattr(ledger, "append_table", lost)
        with pytest.raises(RuntimeError):
            batch(broken, 1, second)
    assert rows_of(broken, "history", spark, "id") == [(1,), (2,)]
    for folder in (broken, clean):
        batch(folder, 1, second)
    for table, columns in {
        "history": ["id", "bill_num", "billed_to", "amount"],
        "history_goods": ["history_id", "line_no", "goods_id", "amount"],
        "goods": ["company_id", "id", "descp"],
        "beneficiaries": ["company_id", "id", "name"],
    }.items():
        assert rows_of(broken, table, spark, *columns) == rows_of(clean, table, spark, *columns)


def test_views_over_the_stored_ledger(spark, stored):
    """The reports work on stored tables, linked by goods id."""
    model = ledger.load_model(spark, stored[0])
    items = views.goods_lines(
        model.history_goods.withColumnRenamed("goods_id", "id"),
        model.goods,
        ["company_id", "id"],
    )
    clients = model.beneficiaries.where("company_id = 1")
    headers = views.header_view(views.tenant_scan(model.history, 1), clients)
    nested = {r.id: r for r in views.history_nested(headers, items).collect()}
    assert sorted(nested) == [1, 2, 3, 5, 7, 8]
    five = nested[5]
    assert (five.bill_label, five.billed_to, five.amount) == ("INV-24/25-04-000002", "Cy", 215)
    # The nut was first sold at 10, so bill 5 shows that rate beside its own amount.
    assert [(l.descp, l.rate, l.good_amount) for l in five.list_of_goods] == [
        ("nut", 10.0, 200.0), ("rod", 10.0, 15.0)
    ]
    latest = views.latest(views.tenant_scan(model.history, 1), 2)
    assert sorted(r.id for r in latest.collect()) == [3, 5, 7, 8]


def test_document_lookup(spark, stored):
    model = ledger.load_model(spark, stored[0])
    found = views.bill_document(model.history, 5, 1).collect()
    assert [r.file_name for r in found] == ["INV-24/25-04-000002.pdf"]
    assert views.bill_document(model.history, 5, 2).isEmpty()


def test_pages_are_ordered_newest_first(spark, stored):
    model = ledger.load_model(spark, stored[0])
    assert [r.id for r in views.newest_first(model.history).collect()] == [8, 7, 6, 5, 3, 2, 1]


def test_one_snapshot_of_last_bills_per_batch_in_use(spark, stored):
    assert ledger.batch_ids(spark, f"{stored[0]}/last_bills/Invoice") == [0, 1]
    last = spark.read.parquet(f"{stored[0]}/last_bills/Invoice/batch_id=1")
    assert sorted((r.company_id, r.bill_num) for r in last.collect()) == [(1, 2), (2, 1)]


def test_keyed_lookup(spark, stored):
    keys = spark.createDataFrame([(1,), (9,)], "id long")
    got = views.lookup(posts.companies(spark), keys, "id", ["custTerms"]).collect()
    assert {r.id: r.custTerms for r in got} == {1: "NET 30", 9: None}


def test_tenant_filter_reaches_the_scan(spark, stored):
    model = ledger.load_model(spark, stored[0])
    bills = views.of_type(views.tenant_scan(model.history, 1), INVOICE).select("id", "amount")
    plan = bills._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(company_id,1)" in plan and "PartitionFilters: [isnotnull(type" in plan
    assert "ReadSchema: struct<id:bigint,amount:bigint,company_id:bigint>" in plan


def test_submission_reader(spark, tmp_path):
    path = str(tmp_path / "in")
    posts.frame(spark, INVOICE, [posts.invoice(1, sname=None)]).write.json(path)
    back = ledger.read_submissions(spark, path, INVOICE).first()
    assert back.sname is None and back.bname == "Ann" and back.qty == ["2", "1.5"]


def test_run_on_an_empty_ledger(spark):
    df = posts.frame(spark, INVOICE, [posts.invoice(1), posts.invoice(2, bname="Ann ")])
    run = runs.run_batch(df, INVOICE, posts.companies(spark))
    assert sorted((r.id, r.bill_num, r.billed_to) for r in run.bills.collect()) == [
        (1, 1, 1), (2, 2, 1)
    ]
    assert run.goods.count() == 2 and run.clients.count() == 1


def test_a_run_keeps_no_documents_beside_the_ledger(spark, tmp_path):
    """The submissions are removed once lines and headers are written, what is printed is packed."""
    folder, post = str(tmp_path / "ledger"), [posts.invoice(1), posts.invoice(2, bname="Bob", qty=["x"])]
    run = runs.run_batch(posts.frame(spark, INVOICE, post), INVOICE, posts.companies(spark))
    assert {p.name for p in Path(run.scratch).iterdir()} == {"repeated", "lines", "headers", "clients", "goods"}
    stored = runs.append_run(run, folder, 0, posts.companies(spark), posts.users(spark))
    printed = [p.name for p in Path(folder).glob("documents/*/part-*")]
    assert printed and all(name.endswith(".json.gz") for name in printed)
    assert [r.id for r in spark.read.json(f"{folder}/documents").collect()] == [1]
    assert all("/bills/" in f for f in stored.bills.inputFiles())
    assert sorted(map(str, stored.bills.collect())) == sorted(map(str, run.bills.collect()))
    assert [r.submission_id for r in run.rejects.collect()] == [2]
    runs.release(stored)
    assert not Path(run.scratch).exists()


def test_two_batches_leave_the_ledger_only(spark, sample, monkeypatch):
    scratch = []

    def shared(session, name):
        scratch.append(shared_dir(session, name))
        return scratch[-1]

    monkeypatch.setattr(runs, "shared_dir", shared)
    folder = queries._two_stored_batches(spark, sample)
    assert len(scratch) == 2 and not any(Path(p).exists() for p in scratch)
    assert spark.read.parquet(f"{folder}/history").count() > 0


def test_deliveries_are_packed(spark, monkeypatch):
    """Small files of packed documents, as a packed file is not cut by the reader."""
    inputs = []

    class Done:
        def awaitTermination(self):
            pass

    def stream(session, source, *_):
        inputs.append(sorted(Path(source).glob("part-*")))
        return Done()

    monkeypatch.setattr(queries.ingest, "ingest_stream", stream)
    monkeypatch.setattr(queries, "DOCUMENTS_PER_FILE", 100)
    queries.stream_ingest_bills(spark, SF_SMALL)
    for files in inputs:
        assert files and all(p.name.endswith(".json.gz") for p in files)
        assert max(len(gzip.open(p).readlines()) for p in files) <= 100

"""Forms, records that cannot be read, documents by id, and table functions."""

import posts
from pyspark.sql import functions as F

from ledgerloom.functions.sql import register_table_functions
from ledgerloom.functions.text import INVOICE
from ledgerloom.operators import validation, views
from ledgerloom.plans import runs
from ledgerloom.session import shared_dir
from ledgerloom.sources import ledger
from ledgerloom.streaming import ingest


def forms(spark, *bodies):
    frame = spark.createDataFrame([(b,) for b in bodies], "value string")
    return ledger.form_submissions(frame, INVOICE)


def test_forms_keep_the_order_of_repeats(spark):
    body = (
        "submission_id=7&company_id=1&bill_date=2024-05-01&descp=b%26w+nut&qty=2&descp=bolt"
        "&qty=&bname=%C3%89va&bname=second&same_info=&descp=a%3Db&gst&&eta"
    )
    row = forms(spark, body).first()
    assert (row.submission_id, row.company_id, str(row.bill_date)) == (7, 1, "2024-05-01")
    assert row.descp == ["b&w nut", "bolt", "a=b"] and row.qty == ["2", ""] and row.gst == [""]
    assert row.bname == "Éva" and row.eta == "" and row.sname is None and row.rate is None
    assert row.same_info is True and row.same_address is False and row.rescued is None


def test_torn_forms_are_kept(spark):
    bodies = ["submission_id=x&company_id=1", "descp=%zz", None, "", "submission_id=&bname=a"]
    rows = forms(spark, *bodies).collect()
    assert [r.rescued for r in rows] == [bodies[0], bodies[1], None, None, bodies[4]]
    assert all(r.submission_id is None for r in rows)


def test_malformed_records_reach_the_rejects_with_their_text(spark):
    folder = shared_dir(spark, "test-torn")
    good = posts.frame(spark, INVOICE, [posts.invoice(1), posts.invoice(2, bname="Bo", baddrPncd="1")])
    torn = [
        '{"submission_id": 3, "company_id": 1',
        '{"submission_id": 4, "company_id": 1, "bill_date": "2024-05-01", "descp": "bolt"}',
        "no json",
    ]
    good.write.json(f"{folder}/in")
    spark.createDataFrame([(t,) for t in torn], "value string").write.mode("append").text(f"{folder}/in")
    ingest.ingest_stream(
        spark, f"{folder}/in", INVOICE, f"{folder}/ledger", f"{folder}/checkpoint",
        posts.companies(spark),
    ).awaitTermination()
    assert [r.id for r in ledger.read_table(spark, f"{folder}/ledger", "history").collect()] == [1]
    rejects = spark.read.parquet(f"{folder}/ledger/rejects").collect()
    assert sorted(r.rescued or "" for r in rejects) == sorted(["", *torn])
    assert {r.rescued: r.error_message for r in rejects if r.submission_id == 4}[torn[1]] == (
        "Record could not be read"
    )


def files_read(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(
        leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size())
    )


def test_documents_by_id_open_few_files(spark):
    folder = shared_dir(spark, "test-index")
    for batch in range(2):
        ids = spark.range(batch * 5000, batch * 5000 + 5000)
        bills = ids.select(
            "id", (F.col("id") % 3).alias("company_id"), F.concat(F.lit("L"), "id").alias("bill_label")
        )
        ledger.append_document_index(bills, folder, batch, stretch=500)
    requests = spark.createDataFrame([(1234, 1), (1235, 1), (9999, 0), (20000, 1), (None, 1)], "id long, company_id long")
    found = ledger.indexed_documents(requests, folder, 500)
    answers = views.document_answers(requests, found).collect()
    assert {(r.id, r.status) for r in answers} == {(1234, 200), (1235, 404), (9999, 200), (20000, 404), (None, 404)}
    one = found.where("id = 1234")
    assert one.collect()[0].bill_label == "L1234"
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,1234)]" in plan
    every = ledger.read_rows(spark, folder, "document_index", ledger.DOCUMENT_INDEX.fields)
    assert files_read(found) <= 4 < 20 <= files_read(every)


def test_index_of_a_run_is_published_with_it(spark):
    folder = shared_dir(spark, "test-run-index")
    run = runs.run_batch(
        posts.frame(spark, INVOICE, [posts.invoice(1), posts.invoice(2)]), INVOICE, posts.companies(spark)
    )
    requests = spark.createDataFrame([(2, 1)], "id long, company_id long")
    assert ledger.indexed_documents(requests, folder).collect() == []
    runs.append_run(run, folder, 0, stretch=10)
    assert views.document_answers(requests, ledger.indexed_documents(requests, folder, 10)).first().status == 200
    ledger.begin_batch(spark, folder, 0)
    assert ledger.indexed_documents(requests, folder, 10).collect() == []


def test_filters_go_through_table_functions(spark):
    path = shared_dir(spark, "test-functions")
    rows = [(i, i % 2, "Invoice", i // 2 + 1, f"2024-0{1 + i % 3}-01") for i in range(20)]
    bills = spark.createDataFrame(rows, "id long, company_id long, type string, bill_num long, d string")
    bills.withColumn("bill_timestamp", F.col("d").cast("timestamp")).write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("some_bills")
    register_table_functions(spark, "some_bills")
    scan = spark.sql("SELECT id FROM tenant_bills(1) WHERE bill_num > 8")
    assert sorted(r.id for r in scan.collect()) == [17, 19]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(company_id,1)" in plan and "GreaterThan(bill_num,8)" in plan
    assert "bill_timestamp" not in plan.split("ReadSchema")[1]
    newest = spark.sql("SELECT id, place FROM newest_bills(1, 2) ORDER BY place").collect()
    assert [tuple(r) for r in newest] == [(19, 1), (17, 2)]
    number = "SELECT next_num FROM next_number({}, 'Invoice', DATE'2024-{}-01')"
    assert [spark.sql(number.format(*a)).first()[0] for a in ((1, "03"), (1, "04"), (5, "04"))] == [11, 1, 1]


def test_form_is_read_once_however_many_rules_follow(spark):
    posts = spark.createDataFrame([("submission_id=1&descp=a%20b&descp=c+d&bname=&bname=x",)], "value string")
    documents = ledger.form_submissions(posts, INVOICE)
    row = documents.first()
    assert (row["descp"], row["bname"], row["same_info"]) == (["a b", "c d"], "", False)
    refused = validation.rejects(runs.checked_submissions(documents, INVOICE))
    plan = refused._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert refused.count() == 1

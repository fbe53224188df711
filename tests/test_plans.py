"""What the physical plans look like."""

import re
import time

import pytest
from compare import SF_SMALL
from pyspark.sql import functions as F

from __spark_entry__ import queries
from ledgerloom import session
from ledgerloom.functions import text
from ledgerloom.functions.text import INVOICE
from ledgerloom.operators import dims, numbering, pricing, validation, views
from ledgerloom.plans import runs
from ledgerloom.session import shared_dir
from ledgerloom.sources import ledger

# These run jobs while they are built; their parts appear in the other queries.
EAGER = {
    "invoice_run",
    "quotation_run",
    "stream_ingest_bills",
    "stream_bill_numbers",
    "company_registrations",
    "account_registrations",
    "company_registry",
    "account_registry",
    "registration_run",
    "registration_rejects",
    "accounts_after_runs",
    "terms_after_runs",
}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(set(queries()) - EAGER))
def test_stays_in_the_jvm_and_joins_on_keys(no_broadcast, name):
    plan = plan_of(queries()[name](no_broadcast, SF_SMALL))
    for operator in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan, operator
    # The sample's default terms are one global minimum of partial ones.
    assert ("Exchange SinglePartition" in plan) == (name == "company_terms_effective")


def scans(plan):
    return [m.split(",") for m in re.findall(r"FileScan parquet \[([^\]]*)\]", re.sub(r"#\d+L?", "", plan))]


def test_only_needed_columns_are_read(spark):
    lineitem = [s for s in scans(plan_of(queries()["bill_totals"](spark, SF_SMALL)))
                if s[0].startswith("l_")]
    assert lineitem == [["l_orderkey", "l_quantity", "l_extendedprice", "l_tax"]]
    orders = scans(plan_of(queries()["all_bills_union"](spark, SF_SMALL)))
    assert all(len(s) <= 5 for s in orders)


def test_type_filter_reaches_the_scan(spark):
    plan = plan_of(queries()["quotation_totals"](spark, SF_SMALL))
    assert "Not(In(o_orderstatus, [F,O]))" in plan
    assert "In(o_orderstatus, [F,O])" in plan_of(queries()["bill_tax_split"](spark, SF_SMALL))


def test_history_reads_the_lines_twice_only(no_broadcast):
    """Once for the goods table, once for the lines; their sums need no third scan."""
    plan = plan_of(queries()["history_lines"](no_broadcast, SF_SMALL))
    assert sum(s[0] == "l_orderkey" for s in scans(plan)) == 2
    # The window over a bill reuses the shuffle of the join by bill id.
    top = plan[: plan.index("LeftOuter")]
    assert "Window" in top and "Exchange" not in top


def test_latest_bills_are_limited_before_the_shuffle(spark, sample):
    bills = sample.headers().select("id", "company_id", "type")
    plan = plan_of(views.latest(bills))
    assert plan.count("WindowGroupLimit") == 2
    assert plan.rindex("WindowGroupLimit") > plan.index("Exchange hashpartitioning")


def test_numbering_never_sorts_a_whole_series(spark, sample):
    bills = sample.headers().select("id", "company_id", "type", "bill_timestamp")
    plan = re.sub(r"#\d+L?", "", plan_of(numbering.number_bills(bills)))
    ranks = re.findall(r"row_number\(\) windowspecdefinition\(([^)]*)", plan)
    assert ranks and all("_bucket" in r for r in ranks)


def test_tenant_scan_reaches_the_files(spark):
    from ledgerloom.plans.queries import QUERIES

    plan = plan_of(QUERIES["tenant_scan"](spark, "/root/testdata/sf0.001"))
    assert "EqualTo(company_id,0)" in plan and "PartitionFilters: [isnotnull(type" in plan
    assert "Exchange" not in plan


def test_first_goods_are_combined_before_the_shuffle(spark, sample):
    lines = sample.lines(sample.headers(), goods=True, line_no=True)
    plan = plan_of(dims.first_goods(lines))
    assert "partial_min" in plan


def test_a_hot_good_is_split_at_run_time(no_broadcast):
    """One good with most lines: the skewed partition is read in several pieces."""
    spark = no_broadcast
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        lines = spark.range(0, 300_000, 1, 8).select(
            F.lit(0).cast("bigint").alias("company_id"),
            F.when(F.col("id") % 10 < 6, F.lit("bolt"))
            .otherwise(F.concat(F.lit("g"), (F.col("id") % 5000).cast("string")))
            .alias("descp"),
            F.xxhash64("id").alias("history_id"),
        )
        goods = lines.groupBy("company_id", "descp").agg(F.max("history_id").alias("id"))
        linked = dims.link_goods(lines, goods.repartition(8))
        assert linked.where("goods_id IS NULL").isEmpty()
        linked.collect()
        assert "skew=true" in plan_of(linked)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def test_bucketed_ledger_is_joined_without_a_shuffle(no_broadcast, sample):
    spark = no_broadcast
    folder = shared_dir(spark, "test-bucketed")
    lines = ledger.save_bucketed(
        sample.lines(sample.headers()), "bucketed_lines", f"{folder}/lines", "history_id", 8
    )
    bills = ledger.save_bucketed(
        sample.headers(), "bucketed_bills", f"{folder}/bills", "id", 8
    )
    try:
        joined = pricing.with_amount(bills, lines)
        assert "Exchange" not in plan_of(joined)
        expected = pricing.with_amount(sample.headers(), sample.lines(sample.headers()))
        assert joined.exceptAll(expected).isEmpty() and joined.count() == expected.count()
    finally:
        spark.sql("DROP TABLE bucketed_lines")
        spark.sql("DROP TABLE bucketed_bills")


def test_stored_dimensions_are_not_shuffled_for_a_small_batch(spark, tmp_path):
    """The batch is broadcast to the stored goods, which stay where they are."""
    path = str(tmp_path / "goods")
    spark.range(1000).select(
        F.lit(1).cast("bigint").alias("company_id"),
        F.concat(F.lit("g"), F.col("id").cast("string")).alias("descp"),
        "id",
    ).write.parquet(path)
    batch = str(tmp_path / "batch")
    spark.createDataFrame([(1, "g5"), (1, "new")], "company_id long, descp string").write.parquet(
        batch
    )
    known = dims.known_rows(spark.read.parquet(path), spark.read.parquet(batch), dims.GOODS_KEY)
    assert [r.id for r in known.collect()] == [5]
    assert "BroadcastHashJoin" in plan_of(known)


def test_kind_constant_is_the_stored_value(sample):
    kinds = {r.type for r in sample.headers().select("type").distinct().collect()}
    assert kinds == {INVOICE, "Quotation"}


def test_partitions_grow_with_the_input():
    gib = 1024**3
    assert [session.wanted_partitions(n * gib) for n in (0, 1, 6, 320, 100 * 1024)] == [0, 32, 192, 10_000, 51_200]
    assert session.RUNTIME_CONF["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == "16m"


def test_posted_documents_are_put_together_once(spark):
    """What repeats documents or cuts them in batches reads them from where they were written."""
    assert "lineitem" not in plan_of(queries()["run_accounting"](spark, SF_SMALL))


def test_few_repeated_ids_do_not_shuffle_the_documents(spark):
    rows = spark.range(3).selectExpr(
        "id % 2 submission_id", "1L company_id", "DATE'2020-01-01' bill_date", "id row",
        "CAST(NULL AS STRING) error_message", "CAST(NULL AS INT) error_status",
    )
    folder = shared_dir(spark, "repeated")
    documents = runs.materialise(rows, folder, "documents")
    stored = spark.createDataFrame([(1,)], "id long")
    repeated = runs.materialise(
        validation.repeated_ids(documents, "row", stored), folder, "repeated"
    )
    refused = validation.refuse_repeated(documents, "row", repeated=repeated)
    assert "Exchange hashpartitioning" not in plan_of(refused)
    plain = validation.refuse_repeated(documents, "row", stored)
    assert sorted(map(tuple, refused.collect())) == sorted(map(tuple, plain.collect()))
    assert {r["row"]: r["error_message"] for r in refused.collect()} == {
        0: None, 1: validation.REPEATED, 2: validation.REPEATED
    }


def test_stripping_adds_no_columns(spark):
    posted = spark.createDataFrame([(" a", "b\u3000", "", None)], "a string, b string, c string, d string")
    stripped = posted.select(*[text.strip(c).alias(c) for c in posted.columns])
    assert "_common_expr" not in plan_of(stripped)
    assert tuple(stripped.first()) == ("a", "b", "", None)


def test_printed_lines_meet_the_headers_last(no_broadcast):
    """Joins with parties shuffle headers only, and lines are shuffled before they are priced."""
    plan = plan_of(queries()["bill_document_flat"](no_broadcast, SF_SMALL))
    assert re.search(r"SortMergeJoin \[([a-z_]+)", plan)[1] == "bill_id"
    assert not re.search(r"Exchange.*\n.*partial_collect_list", plan)


@pytest.mark.parametrize("name", ["history_lines", "history_nested", "bill_document_flat"])
def test_lines_are_put_together_before_the_bills(no_broadcast, name):
    """The joins that lead to lines and headers are over when the two meet."""
    plan = plan_of(queries()[name](no_broadcast, SF_SMALL))
    for table in ("lineitem", "part", "orders", "customer", "supplier"):
        assert f"{table}.parquet" not in plan


def test_shuffles_end_with_their_job(spark, tmp_path):
    """Their files are removed, and a frame that is run again gets them again."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size())}

    def left(before):
        deadline = time.time() + 10
        while files() - before and time.time() < deadline:
            time.sleep(0.1)
        return files() - before

    before = files()
    rows = spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.max("id").alias("m"))
    rows.write.parquet(str(tmp_path / "rows"))
    assert not left(before)
    twice = spark.read.parquet(str(tmp_path / "rows")).repartition(3, "k").groupBy("m").count()
    assert len(twice.collect()) == len(twice.collect()) == 1000


def test_written_lines_are_those_put_together(spark):
    from ledgerloom.plans import queries as q
    from ledgerloom.sources.sample import SampleLedger

    m = SampleLedger(spark, SF_SMALL)
    written = q._written_lines(spark, m)
    lines = q._goods_lines(m, m.headers()).select(*written.columns)
    assert written.count() == lines.count()
    assert written.exceptAll(lines).isEmpty() and lines.exceptAll(written).isEmpty()

"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from ledgerloom.plans.queries import QUERIES
from ledgerloom.session import local_session

HEADLINE = [
    "history_lines",
    "history_nested",
    "latest_bills",
    "bill_document_flat",
    "line_pricing",
    "bill_totals",
    "bill_tax_split",
    "quotation_totals",
    "preview_vs_billed_total",
    "bill_numbers",
    "bill_numbers_incremental",
    "last_bill",
    "bill_labels",
    "bill_amount_words",
    "goods_master",
    "new_goods",
    "line_goods_ids",
    "client_master",
    "bill_party_roles",
    "inventory_goods",
    "inventory_clients",
    "dq_line_rejects",
    "dq_first_error",
    "registry_conflicts",
    "company_registrations",
    "invoice_run",
    "quotation_run",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=cpus)
    # One untimed pass over a small query starts the JVM's code paths.
    QUERIES["bill_totals"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "ledger_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": scale,
            }
        )
    )


if __name__ == "__main__":
    main()

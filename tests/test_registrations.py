"""Registration batches with their sinks, stored updates and publication."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import overlay, registry
from ledgerloom.plans import registrations
from ledgerloom.session import shared_dir
from ledgerloom.sources import ledger
from ledgerloom.sources.schema import ACCOUNT_REGISTRATION

UPDATES = "entity string, key long, field string, value string, seq long, batch_id long"


def accounts_one_by_one(batches):
    """Accepted (id, username) and refused arrivals with their message."""
    held, accepted, refused = set(), [], []
    for batch in batches:
        for arrival, username, email, phno in sorted(batch):
            values = [("username", username)]
            values += [("email", email.strip())] if email.strip() else []
            values += [("phno", phno)] if phno else []
            if not held.isdisjoint(values):
                refused.append(arrival)
            else:
                held.update(values)
                accepted.append((len(accepted) + 1, username))
    return accepted, refused


def posted(spark, rows):
    return spark.createDataFrame(rows, ACCOUNT_REGISTRATION).repartition(3)


def random_accounts(seed, n, start):
    rng = random.Random(seed)
    return [
        (
            start + i,
            f"user{rng.randrange(60)}",
            rng.choice(["", f" m{rng.randrange(40)}@example.com "]),
            rng.choice(["", f"60000000{rng.randrange(10, 60)}"]),
        )
        for i in range(n)
    ]


def test_batches_as_if_one_at_a_time(spark):
    batches = [random_accounts(s, 40, 100 * s) for s in range(1, 4)]
    folder = shared_dir(spark, "registry-test")
    for number, batch in enumerate(batches, 1):
        registrations.register_batch(posted(spark, batch), "account", folder, number)
    accepted, refused = accounts_one_by_one(batches)
    # A batch that is repeated sees what was there before it, and replaces its rows.
    registrations.register_batch(posted(spark, batches[2]), "account", folder, 3)
    got = registrations.accounts(spark, folder).select("id", "username").collect()
    assert sorted(map(tuple, got)) == accepted
    rows = registrations.rejects(spark, folder).collect()
    assert sorted(r.arrival for r in rows) == sorted(refused)
    assert all(r.error_status == 409 and '"username":"user' in r.document for r in rows)
    held = ledger.read_rows(spark, folder, "held_account", registrations.HELD)
    assert held.where("field = 'username'").count() == len(accepted)


def test_only_the_batch_s_buckets_are_read(spark):
    folder = shared_dir(spark, "registry-test")
    stored = [(i, f"name{i}", None, None, "admin", None) for i in range(500)]
    users = spark.createDataFrame(stored, "id long, username string, email string, phno string, type string, company_id long")
    registrations.store_registry(users, "account", folder)
    asked = spark.createDataFrame([(1, "username", "name7")], "arrival long, field string, value string")
    held = registrations.held_values(spark, folder, "account", asked, 1)
    whole = ledger.read_rows(spark, folder, "held_account", registrations.HELD)
    assert "name7" in {r.value for r in held.collect()}
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:400]
    assert held.count() < whole.count() / 10


def test_account_is_linked_to_its_company(spark, sample):
    folder = shared_dir(spark, "registry-test")
    account = posted(spark, [(1, "founder", "f@example.com", "6000000001")])
    registrations.register_batch(account, "account", folder, 1)
    assert registrations.accounts(spark, folder).first().company_id is None
    company = sample.company_registrations().where("arrival = 2").withColumn("created_by", F.lit(1))
    registrations.register_batch(company, "company", folder, 2)
    made = registrations.companies(spark, folder).first()
    assert made is not None and registrations.accounts(spark, folder).first().company_id == made.id

    def terms(text, seq):
        return spark.createDataFrame([(made.id, text, seq)], "id long, custTerms string, seq long")

    registrations.set_terms(terms("NET 10", 9), folder, 3)
    registrations.set_terms(terms("NET 5", 2).unionByName(terms("", 1)), folder, 4)
    assert registrations.companies(spark, folder).first().custTerms == "NET 5"
    registrations.set_terms(terms("", 1), folder, 5)
    assert registrations.companies(spark, folder).first().custTerms == ""


def test_ties_and_unknown_keys_of_updates(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, terms string")
    rows = [
        ("companies", 1, "terms", "x", 5, 1),
        ("companies", 1, "terms", "y", 5, 1),
        ("companies", 2, "terms", None, 9, 9),
        ("companies", 9, "terms", "z", 1, 1),
        ("companies", None, "terms", "z", 1, 1),
        ("users", 3, "terms", "other", 1, 1),
        ("companies", 3, "name", "other", 1, 1),
    ]
    for order in (rows, rows[::-1]):
        updates = spark.createDataFrame(order, UPDATES).repartition(2)
        got = overlay.stored_updates(base, updates, "companies", "terms").collect()
        assert sorted(map(tuple, got)) == [(1, "y"), (2, "b"), (3, None)]


def test_killed_batch_is_invisible(spark, monkeypatch):
    folder = shared_dir(spark, "registry-test")
    first, second = random_accounts(1, 20, 0), random_accounts(2, 20, 100)
    registrations.register_batch(posted(spark, first), "account", folder, 1)
    before = sorted(map(tuple, ledger.read_table(spark, folder, "users").collect()))

    def killed(*args):
        raise RuntimeError("killed")

    for name in ("_write_held", "ledger.publish_batch"):
        with monkeypatch.context() as patch:
            patch.setattr(f"ledgerloom.plans.registrations.{name}", killed)
            with pytest.raises(RuntimeError):
                registrations.register_batch(posted(spark, second), "account", folder, 2)
        assert ledger.batch_ids(spark, f"{folder}/users") == [1, 2]
        assert sorted(map(tuple, ledger.read_table(spark, folder, "users").collect())) == before
    registrations.register_batch(posted(spark, second), "account", folder, 2)
    got = [(r.id, r.username) for r in ledger.read_table(spark, folder, "users").collect()]
    assert sorted(got) == accounts_one_by_one([first, second])[0]


@pytest.mark.parametrize("shape", ["chain", "shuffled chain", "tree"])
def test_long_chains_settle_in_few_rounds(spark, monkeypatch, shape):
    """Groups too large for one task are settled by following chains in doubled steps."""
    monkeypatch.setattr(registry, "GROUP_VALUES", 100)
    rounds = []
    settle = registry._chained_round

    def counted(*args):
        rounds.append(1)
        return settle(*args)

    monkeypatch.setattr(registry, "_chained_round", counted)
    n, rng = 3000, random.Random(1)
    if shape == "tree":
        links = [(rng.randrange(max(0, i - 3), i), i) for i in range(1, n)]
    else:
        order = list(range(n))
        if shape == "shuffled chain":
            rng.shuffle(order)
        links = list(zip(order, order[1:], strict=False))
    values = {}
    for number, (a, b) in enumerate(links):
        values.setdefault(a, []).append(f"v{number}")
        values.setdefault(b, []).append(f"v{number}")
    held, expected = set(), []
    for arrival in sorted(values):
        if held.isdisjoint(values[arrival]):
            held.update(values[arrival])
            expected.append(arrival)
    rows = [(a, "f", v) for a, mine in values.items() for v in mine]
    frame = spark.createDataFrame(rows, "arrival long, field string, value string").repartition(3)
    got = [r.arrival for r in registry._settle(frame).collect()]
    assert sorted(got) == expected
    assert len(rounds) <= 6

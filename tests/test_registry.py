"""Registrations in bulk against registrations handled one by one."""

import random

import pytest

from ledgerloom.operators import overlay, registry
from ledgerloom.session import shared_dir
from ledgerloom.sources import ledger
from ledgerloom.sources.schema import ACCOUNT_REGISTRATION, COMPANY_REGISTRATION

ACCOUNT = ACCOUNT_REGISTRATION
USERS = "id long, username string, email string, phno string"


def account(arrival, rng):
    return (
        arrival,
        rng.choice(["alice", "bobby", "carol", "daisy", "abc", f"user{arrival}"]),
        rng.choice(["a@x.co", " b@x.co ", "bad", "", f"m{arrival}@x.co", "c@x.co"]),
        rng.choice(["6000000001", "6000000002", "12", "", f"7{arrival:09d}"]),
    )


def accounts_one_by_one(rows, users):
    held = {f: {u[i] for u in users if u[i]} for i, f in ((1, "u"), (2, "e"), (3, "p"))}
    out = {}
    for arrival, name, mail, phone in rows:
        if None in (name, mail, phone):
            absent = [n for n, v in zip(("username", "email", "phno"), (name, mail, phone))
                      if v is None]
            out[arrival] = (", ".join(absent) + " not provided", 403)
            continue
        mail = mail.strip()
        if len(name) < 5:
            out[arrival] = ("Username must be at least 5 characters", 403)
        elif name in held["u"]:
            out[arrival] = ("Username already exists", 409)
        elif mail and "@x.co" not in mail:
            out[arrival] = ("Invalid email address", 403)
        elif mail and mail in held["e"]:
            out[arrival] = ("Email already registered", 409)
        elif phone and len(phone) != 10:
            out[arrival] = ("Invalid phone number", 403)
        elif phone and phone in held["p"]:
            out[arrival] = ("Phone number already registered", 409)
        else:
            out[arrival] = (None, None)
            held["u"].add(name)
            if mail:
                held["e"].add(mail)
            if phone:
                held["p"].add(phone)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_accounts(spark, seed):
    rng = random.Random(seed)
    rows = [account(i, rng) for i in range(60)] + [(60, None, "z@x.co", None)]
    users = [(1, "bobby", "c@x.co", None), (2, "zelda", None, "6000000002")]
    batch = spark.createDataFrame(random.Random(0).sample(rows, len(rows)), ACCOUNT)
    got = registry.register_accounts(batch, spark.createDataFrame(users, USERS)).collect()
    assert {r.arrival: (r.error_message, r.error_status) for r in got} == accounts_one_by_one(
        rows, users
    )


def test_a_refused_registration_holds_no_value(spark):
    rows = [
        (1, "first", "a@x.co", "6000000001"),
        (2, "second", "a@x.co", "6000000002"),  # refused: e-mail of 1
        (3, "third", "b@x.co", "6000000002"),  # accepted: 2 holds nothing
        (4, "fourth", "b@x.co", "6000000004"),  # refused: e-mail of 3
        (5, "fourth", "c@x.co", "6000000004"),  # accepted
    ]
    users = spark.createDataFrame([], USERS)
    got = registry.register_accounts(spark.createDataFrame(rows, ACCOUNT), users).collect()
    assert sorted(r.arrival for r in got if r.error_message is None) == [1, 3, 5]


def test_long_chain_of_conflicts(spark):
    rows = [(i, f"name{i // 2}", "", f"6{(i + 1) // 2:09d}") for i in range(21)]
    users = spark.createDataFrame([], USERS)
    got = registry.register_accounts(spark.createDataFrame(rows, ACCOUNT), users).collect()
    assert {r.arrival: (r.error_message, r.error_status) for r in got} == accounts_one_by_one(
        [(a, n, m, p) for a, n, m, p in rows], []
    )


def company(arrival, **fields):
    row = dict.fromkeys(COMPANY_REGISTRATION.names, "")
    row.update(
        arrival=arrival, company_name=f"Firm {arrival}", addrBno="1", addrSt="s", addrLoc="l",
        addrDist="d", addrState="st", addrPncd="560001", phno1=f"6{arrival:09d}", created_by=arrival,
    )
    row.update(fields)
    return tuple(row[n] for n in COMPANY_REGISTRATION.names)


def test_companies(spark, sample):
    stored = sample.companies()
    taken = stored.where("gstin IS NOT NULL AND bnkAcno IS NOT NULL").first()
    rows = [
        company(1),
        company(2, phno1=f"6{1:09d}"),
        company(3, website=None, gstin=None),
        company(4, company_name="  ", addrState=""),
        company(5, addrPncd="012345", phno1="1"),
        company(6, phno1="1"),
        company(7, phno2="1", email="bad"),
        company(8, email="bad"),
        company(9, email="e@x.co"),
        company(10, email=" e@x.co "),
        company(11, gstin=taken.gstin),
        company(12, bnkAcno=taken.bnkAcno),
        company(13, phno1=taken.phno1),
    ]
    got = registry.register_companies(
        spark.createDataFrame(rows, COMPANY_REGISTRATION), stored
    ).collect()
    assert {r.arrival: (r.error_message, r.error_status) for r in got} == {
        1: (None, None),
        2: ("Mobile number already registered", 409),
        3: ("website, gstin not provided", 403),
        4: ("company-name, addrState not provided", 403),
        5: ("Invalid Pincode", 403),
        6: ("Invalid mobile number", 403),
        7: ("Invalid phone number", 400),
        8: ("Invalid email", 400),
        9: (None, None),
        10: ("Email already registered", 409),
        11: ("GSTIN already registered", 409),
        12: ("Bank account number already registered", 409),
        13: ("Mobile number already registered", 409),
    }


def test_posted_registrations_are_read(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([company(1, website=None)], COMPANY_REGISTRATION).write.json(path)
    row = ledger.read_registrations(spark, path, "company").first()
    assert (row.arrival, row.company_name, row.website) == (1, "Firm 1", None)


def test_last_terms_update_wins_and_blank_is_a_value(spark):
    base = spark.createDataFrame([(1, "old"), (2, "old"), (3, None)], "id long, custTerms string")
    updates = spark.createDataFrame(
        [(1, 1, "a"), (2, 1, ""), (3, None, "x"), (4, 9, "x"), (5, 2, None)],
        "seq long, id long, custTerms string",
    )
    defaults = spark.createDataFrame([("std",)], "custTerms string")
    got = overlay.effective_terms(base, updates, defaults).collect()
    assert {r.id: (r.custTerms, r.default_terms) for r in got} == {
        1: ("", "std"), 2: ("old", "std"), 3: (None, "std"),
    }


def test_account_is_linked_to_its_company(spark):
    users = spark.createDataFrame([(1, None), (2, 5)], "id long, company_id long")
    companies = spark.createDataFrame([(10, 1), (11, 7)], "id long, created_by long")
    got = overlay.link_accounts(users, companies).collect()
    assert {r.id: r.company_id for r in got} == {1: 10, 2: 5}


def test_accepted_registrations_are_appended(spark, sample):
    folder = shared_dir(spark, "test-registry")
    ledger.append_table(sample.companies(), folder, "companies", 0)
    stored = ledger.read_table(spark, folder, "companies").drop("batch_id")
    batch = spark.createDataFrame(
        [company(30), company(10), company(20, email="bad"), company(11, phno1=f"6{10:09d}")],
        COMPANY_REGISTRATION,
    )
    rows = registry.company_rows(registry.register_companies(batch, stored), stored)
    ledger.append_table(rows, folder, "companies", 1)
    got = ledger.read_table(spark, folder, "companies").where("batch_id = 1")
    highest = sample.companies().agg({"id": "max"}).first()[0]
    assert sorted((r.id, r.name, r.created_by) for r in got.collect()) == [
        (highest + 1, "Firm 10", 10), (highest + 2, "Firm 30", 30),
    ]
    # The second batch meets the first one's values in the store.
    stored = ledger.read_table(spark, folder, "companies").drop("batch_id")
    again = registry.register_companies(batch.where("arrival = 30"), stored).first()
    assert again.error_message == "Mobile number already registered"


def test_accepted_accounts(spark):
    users = spark.createDataFrame([(7, "zelda", None, None)], USERS)
    batch = spark.createDataFrame(
        [(1, "alice", " a@x.co ", ""), (2, "abc", "", ""), (3, "bobby", "", "6000000001")], ACCOUNT
    )
    rows = registry.account_rows(registry.register_accounts(batch, users), users)
    assert sorted(tuple(r) for r in rows.collect()) == [
        (8, "alice", "a@x.co", None, "admin", None),
        (9, "bobby", None, "6000000001", "admin", None),
    ]


def test_long_chains_settle_in_few_rounds(spark, monkeypatch):
    """A thousand registrations, each sharing a value with the next one: every other one is
    accepted, and the files written do not grow with the chain."""
    rounds = []
    one_round = registry._round
    monkeypatch.setattr(registry, "_round", lambda df: rounds.append(1) or one_round(df))
    rows = [(i, f"f{k % 2}", f"v{k}") for i in range(1000) for k in (i, i + 1)]
    values = spark.createDataFrame(rows, "arrival long, field string, value string")
    accepted = {r.arrival for r in registry._settle(values).collect()}
    assert accepted == set(range(0, 1000, 2))
    assert len(rounds) <= 3


def test_large_groups_stay_in_the_rounds(spark, monkeypatch):
    monkeypatch.setattr(registry, "GROUP_VALUES", 3)
    rows = [(i, "f", f"v{k}") for i in range(12) for k in (i, i + 1)]
    rows += [(100, "f", "x"), (101, "f", "x"), (101, "f", "y")]
    values = spark.createDataFrame(rows, "arrival long, field string, value string")
    accepted = {r.arrival for r in registry._settle(values).collect()}
    assert accepted == {0, 2, 4, 6, 8, 10, 100}


def test_rounds_broadcast_nothing(spark, tmp_path):
    rows = [(1, "phno", "a"), (2, "phno", "a"), (2, "email", "b"), (3, "email", "b")]
    spark.createDataFrame(rows, "arrival long, field string, value string").write.parquet(str(tmp_path / "open"))
    open_values = spark.read.parquet(str(tmp_path / "open"))
    plain = registry._round(open_values)
    chained = registry._chained_round(open_values, str(tmp_path / "round"))
    grouped = registry._grouped(open_values, str(tmp_path))
    for frame in (*plain, *chained, grouped):
        frame.collect()
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
    assert [r.arrival for r in plain[0].collect()] == [1]
    assert sorted(r.arrival for r in chained[0].collect()) == [1, 3]
    assert {r.label for r in grouped.collect()} == {1}

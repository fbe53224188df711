"""Registration of companies and accounts with uniqueness rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import checks
from ledgerloom.functions.text import blank_to_null, strip
from ledgerloom.operators.ranking import id_ranges, numbered
from ledgerloom.session import shared_dir
from ledgerloom.sources.ledger import delete_path
from ledgerloom.sources.schema import COMPANY_OPTIONAL, COMPANY_REQUIRED

COMPANY_UNIQUE = ("phno1", "email", "gstin", "bnkAcno")
ACCOUNT_UNIQUE = ("username", "email", "phno")


# --- cleaning ---------------------------------------------------------------------


def clean_companies(df: DataFrame) -> DataFrame:
    """Record absent fields, then strip all fields and turn blanks into NULL."""
    fields = COMPANY_REQUIRED + COMPANY_OPTIONAL
    absent = checks.absent_fields({f.replace("_", "-"): F.col(f) for f in fields})
    return df.withColumn("missing", absent).withColumns(
        {f: blank_to_null(strip(f)) for f in fields}
    )


def clean_accounts(df: DataFrame) -> DataFrame:
    """Only the e-mail is stripped; a blank e-mail or phone is no value."""
    absent = checks.absent_fields({f: F.col(f) for f in ACCOUNT_UNIQUE})
    return df.withColumn("missing", absent).withColumns(
        {"email": blank_to_null(strip("email")), "phno": blank_to_null(F.col("phno"))}
    )


# --- uniqueness -------------------------------------------------------------------


def unique_values(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row per registration and filled unique field."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return (
        df.select("arrival", F.explode(pairs).alias("p"))
        .where(F.col("p.value").isNotNull())
        .select("arrival", "p.field", "p.value")
    )


def stored_values(stored: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    keyed = stored.select(F.col("id").alias("arrival"), *fields)
    return unique_values(keyed, fields).select("field", "value").distinct()


def conflicts(batch: DataFrame, stored: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Every unique field value of a batch with its possible conflicts.

    ``first_arrival`` is the earliest registration of the batch with that value;
    ``in_store`` says that a stored row has it.  The first holder is found by an
    aggregation, so a value many share is reduced before it is shuffled.
    """
    values = unique_values(batch, fields)
    first = values.groupBy("field", "value").agg(F.min("arrival").alias("first_arrival"))
    known = stored_values(stored, fields).withColumn("in_store", F.lit(True))
    return (
        values.join(
            first.join(known, ["field", "value"], "left"), ["field", "value"]
        )
        .withColumn("in_store", F.coalesce("in_store", F.lit(False)))
        .withColumn("in_batch", F.col("first_arrival") < F.col("arrival"))
    )


def _taken(field: str) -> Column:
    """True when the value of ``field`` is held by the store or an earlier registration."""
    return F.coalesce(F.col(f"taken_{field}"), F.lit(False))


def company_rules() -> list[tuple[Column, Column | str, int]]:
    """Rules in the order they are checked."""
    blank = checks.blank_fields({f.replace("_", "-"): F.col(f) for f in COMPANY_REQUIRED})
    invalid = lambda rule, c: ~checks.optional(rule, F.col(c))
    return [
        (F.col("missing") != "", F.concat("missing", F.lit(" not provided")), 403),
        (blank != "", F.concat(blank, F.lit(" not provided")), 403),
        (invalid(checks.is_valid_pncd, "addrPncd"), "Invalid Pincode", 403),
        (invalid(checks.is_valid_phno, "phno1"), "Invalid mobile number", 403),
        (_taken("phno1"), "Mobile number already registered", 409),
        (invalid(checks.is_valid_phno, "phno2"), "Invalid phone number", 400),
        (invalid(checks.is_valid_email, "email"), "Invalid email", 400),
        (_taken("email"), "Email already registered", 409),
        (_taken("gstin"), "GSTIN already registered", 409),
        (_taken("bnkAcno"), "Bank account number already registered", 409),
    ]


def account_rules() -> list[tuple[Column, Column | str, int]]:
    invalid = lambda rule, c: ~checks.optional(rule, F.col(c))
    short = ~checks.min_length(F.col("username"), checks.USERNAME_MIN_LENGTH)
    return [
        (F.col("missing") != "", F.concat("missing", F.lit(" not provided")), 403),
        (short, "Username must be at least 5 characters", 403),
        (_taken("username"), "Username already exists", 409),
        (invalid(checks.is_valid_email, "email"), "Invalid email address", 403),
        (_taken("email"), "Email already registered", 409),
        (invalid(checks.is_valid_phno, "phno"), "Invalid phone number", 403),
        (_taken("phno"), "Phone number already registered", 409),
    ]


def _with_taken(df: DataFrame, taken: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Add one flag per unique field from rows (arrival, field) of ``taken``."""
    flags = taken.groupBy("arrival").agg(
        *[F.max(F.col("field") == f).alias(f"taken_{f}") for f in fields]
    )
    return df.join(flags, "arrival", "left")


def _apply_rules(df: DataFrame, rules) -> DataFrame:
    message, status = checks.first_error(rules)
    return df.withColumn("error_message", message).withColumn("error_status", status)


# Rounds go on as long as each leaves at most this share of the values open.
SHRINKING = 0.5
# Values of one group of conflicts that are handled in order by one task.
GROUP_VALUES = 50_000
# Rounds are many, and what each of them broadcast would go through the driver.
JOIN = "merge"
VALUE = ["field", "value"]


def _round(open_values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accept whoever comes first for all of its values; winners and what stays open."""
    first = open_values.groupBy(*VALUE).agg(F.min("arrival").alias("first_arrival"))
    winners = (
        open_values.hint(JOIN).join(first, VALUE)
        .groupBy("arrival")
        .agg(F.bool_and(F.col("arrival") == F.col("first_arrival")).alias("wins"))
        .where("wins")
        .select("arrival")
    )
    taken = open_values.hint(JOIN).join(winners, "arrival", "left_semi").select(*VALUE).distinct()
    # A winner's own values are taken too, so this drops winners and losers alike.
    settled = open_values.hint(JOIN).join(taken, VALUE, "left_semi").select("arrival").distinct()
    return winners, open_values.hint(JOIN).join(settled, "arrival", "left_anti")


def _followed(links: DataFrame, folder: str) -> DataFrame:
    """Links (node, to, odd) followed to where no link goes on; ``odd`` tells their number.

    Each round joins a link with the one it leads to, so rounds are as many as the logarithm
    of the longest path.
    """
    spark = links.sparkSession
    links.write.parquet(f"{folder}/followed-0")
    step = 0
    while True:
        links = spark.read.parquet(f"{folder}/followed-{step}")
        after = links.select(
            F.col("node").alias("to"), F.col("to").alias("then"), F.col("odd").alias("then_odd")
        )
        if links.hint(JOIN).join(after, "to", "left_semi").isEmpty():
            return links
        further = links.hint(JOIN).join(after, "to", "left").select(
            "node",
            F.coalesce("then", "to").alias("to"),
            (F.col("odd") != F.coalesce("then_odd", F.lit(False))).alias("odd"),
        )
        further.write.parquet(f"{folder}/followed-{step + 1}")
        delete_path(spark, f"{folder}/followed-{step}")
        step += 1


def _chained_round(open_values: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Like ``_round``, and settles whole chains at once.

    Whoever comes first for all its values is accepted.  Whoever has a single open
    registration before it is accepted exactly when that one is refused; such links are
    composed along their paths.  Those with several before them wait for the next round.
    """
    first = open_values.groupBy(*VALUE).agg(F.min("arrival").alias("first"))
    behind = open_values.hint(JOIN).join(first, VALUE).where(F.col("arrival") > F.col("first"))
    second = behind.groupBy(*VALUE).agg(F.min("arrival").alias("second"))
    waiting = (
        behind.hint(JOIN).join(second, VALUE)
        .groupBy("arrival")
        .agg(
            F.min("first").alias("to"),
            (
                (F.min("first") == F.max("first"))
                & F.bool_and(F.col("arrival") == F.col("second"))
            ).alias("single"),
        )
    )
    waiting.write.parquet(f"{folder}/waiting")
    waiting = open_values.sparkSession.read.parquet(f"{folder}/waiting")
    links = waiting.where("single").select(
        F.col("arrival").alias("node"), "to", F.lit(True).alias("odd")
    )
    ends = _followed(links, folder)
    sources = open_values.select("arrival").distinct().hint(JOIN).join(waiting, "arrival", "left_anti")
    even = (
        ends.where("NOT odd")
        .hint(JOIN).join(waiting.select(F.col("arrival").alias("to")), "to", "left_anti")
        .select(F.col("node").alias("arrival"))
    )
    winners = sources.unionByName(even)
    taken = open_values.hint(JOIN).join(winners, "arrival", "left_semi").select(*VALUE).distinct()
    settled = open_values.hint(JOIN).join(taken, VALUE, "left_semi").select("arrival").distinct()
    return winners, open_values.hint(JOIN).join(settled, "arrival", "left_anti")


def _grouped(open_values: DataFrame, folder: str) -> DataFrame:
    """Open values with the smallest arrival of their group of conflicts.

    Labels go to the smallest neighbour and then to that one's label, so the rounds grow
    with the logarithm of a chain's length.
    """
    spark = open_values.sparkSession
    labels = open_values.select("arrival", F.col("arrival").alias("label")).distinct()
    step = 0
    while True:
        near = (
            open_values.hint(JOIN).join(labels, "arrival")
            .groupBy(*VALUE)
            .agg(F.min("label").alias("near"))
        )
        hooked = (
            open_values.hint(JOIN).join(near, VALUE).groupBy("arrival").agg(F.min("near").alias("label"))
        )
        roots = hooked.select(F.col("arrival").alias("label"), F.col("label").alias("root"))
        jumped = hooked.hint(JOIN).join(roots, "label").select("arrival", F.col("root").alias("label"))
        path = f"{folder}/labels-{step}"
        jumped.write.parquet(path)
        moved = spark.read.parquet(path)
        old = labels.withColumnRenamed("label", "old")
        done = moved.hint(JOIN).join(old, "arrival").where(F.col("label") != F.col("old")).isEmpty()
        if step > 0:
            delete_path(spark, f"{folder}/labels-{step - 1}")
        labels, step = moved, step + 1
        if done:
            return open_values.hint(JOIN).join(labels, "arrival")


def _in_order(group: pd.DataFrame) -> pd.DataFrame:
    """Registrations of one group, one after the other."""
    held: set[tuple[str, str]] = set()
    accepted = []
    for arrival, rows in group.sort_values("arrival", kind="stable").groupby("arrival"):
        mine = set(zip(rows["field"], rows["value"], strict=True))
        if not mine & held:
            held |= mine
            accepted.append(arrival)
    return pd.DataFrame({"arrival": pd.Series(accepted, dtype="int64")})


def _settle(values: DataFrame) -> DataFrame:
    """Accepted arrivals when registrations are taken in order of arrival.

    A registration is accepted when no accepted earlier one holds any of its values.  Each
    round accepts every open registration that comes first for all its values and
    refuses those that share a value with one of them.  Once a round leaves most open, as
    long chains do, groups of conflicts that fit into a task are handled in order there;
    larger ones go through rounds that settle whole chains.  Every round replaces the files of
    the one before.
    """
    spark = values.sparkSession
    folder = shared_dir(spark, "registrations")
    values.select("arrival", *VALUE).write.parquet(f"{folder}/open-0")
    step, grouped = 0, False
    open_values = spark.read.parquet(f"{folder}/open-0")
    n_open = open_values.count()
    spark.createDataFrame([], "arrival long").write.parquet(f"{folder}/accepted/round=-1")
    while n_open:
        if grouped:
            winners, left = _chained_round(open_values, f"{folder}/round-{step}")
        else:
            winners, left = _round(open_values)
        winners.write.parquet(f"{folder}/accepted/round={2 * step}")
        left.write.parquet(f"{folder}/open-{step + 1}")
        open_values = spark.read.parquet(f"{folder}/open-{step + 1}")
        before, n_open = n_open, open_values.count()
        if n_open > SHRINKING * before and not grouped:
            grouped = True
            parted = _grouped(open_values, folder)
            sizes = parted.groupBy("label").agg(F.count("*").alias("n"))
            small = parted.join(sizes.where(F.col("n") <= GROUP_VALUES), "label")
            done = small.select("label", "arrival", *VALUE).groupBy("label").applyInPandas(
                _in_order, "arrival long"
            )
            done.write.parquet(f"{folder}/accepted/round={2 * step + 1}")
            large = parted.join(sizes.where(F.col("n") > GROUP_VALUES), "label")
            large.select("arrival", *VALUE).write.parquet(f"{folder}/large")
            open_values = spark.read.parquet(f"{folder}/large")
            n_open = open_values.count()
        delete_path(spark, f"{folder}/open-{step}")
        delete_path(spark, f"{folder}/round-{step}")
        step += 1
    return spark.read.parquet(f"{folder}/accepted").select("arrival")


def register(
    batch: DataFrame, stored: DataFrame, fields: tuple[str, ...], rules
) -> DataFrame:
    """Accept or refuse each registration of a cleaned batch as if handled one by one.

    A refused registration holds none of its values, so a later one may still use them.
    """
    return register_against(batch, stored_values(stored, fields), fields, rules)


def register_against(
    batch: DataFrame, held: DataFrame, fields: tuple[str, ...], rules
) -> DataFrame:
    """``register`` with the values (field, value) the store holds."""
    values = unique_values(batch, fields)
    in_store = values.join(held, ["field", "value"], "left_semi").select("arrival", "field")
    eligible = _apply_rules(_with_taken(batch, in_store, fields), rules).where(
        F.col("error_message").isNull()
    )
    accepted = _settle(unique_values(eligible, fields))
    held = (
        values.join(accepted, "arrival", "left_semi")
        .groupBy("field", "value")
        .agg(F.min("arrival").alias("holder"))
    )
    earlier = (
        values.join(held, ["field", "value"])
        .where(F.col("holder") < F.col("arrival"))
        .select("arrival", "field")
    )
    return _apply_rules(_with_taken(batch, in_store.unionByName(earlier), fields), rules)


def register_companies(batch: DataFrame, stored: DataFrame) -> DataFrame:
    return register(clean_companies(batch), stored, COMPANY_UNIQUE, company_rules())


def register_accounts(batch: DataFrame, stored: DataFrame) -> DataFrame:
    return register(clean_accounts(batch), stored, ACCOUNT_UNIQUE, account_rules())


def new_rows(registered: DataFrame, stored: DataFrame) -> DataFrame:
    """Accepted registrations with the next ids, in order of arrival.

    The ids run over all rows: each range of arrivals is sorted on its own, and only one
    count per range is brought together.
    """
    accepted = registered.where(F.col("error_message").isNull())
    ranges = id_ranges(registered, "arrival")
    ranked = numbered(accepted, [], ["arrival"], ranges.of(F.col("arrival")), "id")
    highest = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).scalar()
    return ranked.withColumn("id", F.col("id") + highest)


def company_rows(registered: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows to append to the companies."""
    return new_rows(registered, stored).withColumnRenamed("company_name", "name").drop(
        "arrival", "missing"
    )


def account_rows(registered: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows to append to the users; a new account has no company yet."""
    return (
        new_rows(registered, stored)
        .withColumn("type", F.lit("admin"))
        .withColumn("company_id", F.lit(None).cast("bigint"))
        .select("id", "username", "email", "phno", "type", "company_id")
    )

"""Get-or-insert of goods and parties; the first one to arrive wins and never changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import blank_to_null, is_blank
from ledgerloom.operators.ranking import IdRanges, id_ranges, numbered
from ledgerloom.sources.schema import PARTY_FIELDS

GOODS_KEY = ["company_id", "descp"]
CLIENT_KEY = ["company_id", "name", "phno1"]
GOODS_ATTRIBUTES = ["hsn_sac", "uom", "rate", "gst", "user_id"]


def first_goods(lines: DataFrame, by: bool = True) -> DataFrame:
    """First line of each description per company, combined before any shuffle.

    Without ``by`` the account that added a good is left out.
    """
    attributes = [a for a in GOODS_ATTRIBUTES if by or a != "user_id"]
    first = F.min(F.struct("history_id", "line_no", *attributes)).alias("_first")
    return (
        lines.groupBy(*GOODS_KEY)
        .agg(first)
        .select(
            *GOODS_KEY,
            blank_to_null(F.col("_first.hsn_sac")).alias("hsn_sac"),
            blank_to_null(F.col("_first.uom")).alias("uom"),
            F.col("_first.rate").alias("rate"),
            F.col("_first.gst").alias("gst"),
            *([F.col("_first.user_id").alias("added_by")] if by else []),
            F.col("_first.history_id").alias("first_bill"),
            F.col("_first.line_no").alias("first_line"),
        )
    )


def known_rows(stored: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows a batch refers to.

    The batch is the side to broadcast when it is small, so a large stored table is
    filtered where it lies instead of being shuffled for every batch.
    """
    return stored.join(wanted.select(*keys).distinct(), keys, "left_semi")


def new_goods(lines: DataFrame, stored: DataFrame) -> DataFrame:
    """Goods of the lines whose exact description the company does not have yet."""
    first = first_goods(lines)
    known = known_rows(stored.select(*GOODS_KEY), first, GOODS_KEY)
    return first.join(known, GOODS_KEY, "left_anti")


def with_ids(
    rows: DataFrame,
    arrival: list[str],
    stored: DataFrame | None = None,
    ranges: IdRanges | None = None,
) -> DataFrame:
    """Give new rows the next ids of their company, in order of arrival.

    ``arrival`` starts with a bill id, whose ``ranges`` bound each sort.
    """
    ranges = ranges or id_ranges(rows, arrival[0])
    ranked = numbered(rows, ["company_id"], arrival, ranges.of(F.col(arrival[0])), "id")
    if stored is None:
        return ranked
    highest = stored.groupBy("company_id").agg(F.max("id").alias("_max_id"))
    return (
        ranked.join(highest, "company_id", "left")
        .withColumn("id", F.col("id") + F.coalesce("_max_id", F.lit(0)))
        .drop("_max_id")
    )


def goods_master(lines: DataFrame, ranges: IdRanges | None = None) -> DataFrame:
    """The whole goods table as built from all lines."""
    return with_ids(first_goods(lines), ["first_bill", "first_line"], ranges=ranges)


def goods_ids(goods: DataFrame) -> DataFrame:
    """Description to id; with duplicate descriptions the largest id counts."""
    return goods.groupBy(*GOODS_KEY).agg(F.max("id").alias("goods_id"))


def link_goods(lines: DataFrame, goods: DataFrame) -> DataFrame:
    """Lines with the id of their goods."""
    return lines.join(goods_ids(goods), GOODS_KEY, "left")


# --- parties ---------------------------------------------------------------------

IDENTITY = ["company_id", "name", "_phone", "_bill", "_role"]


def party_mentions(bills: DataFrame, attributes: list[str]) -> DataFrame:
    """One row per bill and named party, billing before shipping.

    ``bills`` holds b*- and s*-columns.  A shipping party with the billing party's name
    and phone is the same party and is not mentioned again; a blank name is no party.
    Shipping parties never store a GSTIN.
    """
    billing = F.struct(F.lit(1).alias("role"), *[F.col("b" + a).alias(a) for a in attributes])
    shipping = F.struct(
        F.lit(2).alias("role"),
        *[
            (F.lit("") if a == "gstin" else F.col("s" + a)).alias(a)
            for a in attributes
        ],
    )
    return (
        bills.withColumn(
            "_party",
            F.explode(
                F.array(
                    F.when(~is_blank(F.col("bname")), billing),
                    F.when(~is_blank(F.col("sname")) & ~same_party(), shipping),
                )
            ),
        )
        .where(F.col("_party").isNotNull())
        .select(
            "company_id",
            "user_id",
            F.col("id").alias("bill_id"),
            "_party.role",
            *[blank_to_null(F.col("_party." + a)).alias(a) for a in attributes],
        )
    )


def same_party() -> Column:
    """Whether bill-to and ship-to carry the same name and phone."""
    return (F.col("bname") == F.col("sname")) & (F.col("bphno1") == F.col("sphno1"))


def with_identity(mentions: DataFrame) -> DataFrame:
    """Add what makes two mentions the same party: name and phone, never NULL.

    A party without a phone equals no other one, so its own bill and role stand in for
    the phone.
    """
    no_phone = F.col("phno1").isNull()
    return (
        mentions.withColumn("_phone", F.coalesce("phno1", F.lit("")))
        .withColumn("_bill", F.when(no_phone, F.col("bill_id")).otherwise(F.lit(-1)))
        .withColumn("_role", F.when(no_phone, F.col("role")).otherwise(F.lit(0)))
    )


def first_parties(mentions: DataFrame) -> DataFrame:
    """Parties to insert: the first mention of each, combined before any shuffle."""
    attributes = [c for c in mentions.columns if c in PARTY_FIELDS]
    others = [a for a in attributes if a not in ("name", "phno1")]
    first = F.min(F.struct("bill_id", "role", "user_id", "phno1", *others)).alias("_first")
    return (
        with_identity(mentions)
        .groupBy(*IDENTITY)
        .agg(first)
        .select(
            "company_id",
            "name",
            F.col("_first.phno1").alias("phno1"),
            F.col("_first.bill_id").alias("first_bill"),
            F.col("_first.role").alias("first_role"),
            F.col("_first.user_id").alias("added_by"),
            *[F.col("_first." + a).alias(a) for a in others],
        )
    )


def new_clients(mentions: DataFrame, stored: DataFrame) -> DataFrame:
    """Parties not stored yet.  NULL phones match nothing, as with SQL equality."""
    first = first_parties(mentions)
    return first.join(known_clients(mentions, stored), CLIENT_KEY, "left_anti")


def known_clients(mentions: DataFrame, stored: DataFrame) -> DataFrame:
    return known_rows(stored.select(*CLIENT_KEY, "id"), mentions, CLIENT_KEY)


def client_master(mentions: DataFrame, ranges: IdRanges | None = None) -> DataFrame:
    return with_ids(first_parties(mentions), ["first_bill", "first_role"], ranges=ranges)


def party_ids(
    mentions: DataFrame, stored: DataFrame | None, inserted: DataFrame
) -> DataFrame:
    """Id of every mention: the stored party with the smallest id, else the inserted one."""
    parties = inserted.select(
        *CLIENT_KEY, "id", F.col("first_bill").alias("bill_id"), F.col("first_role").alias("role")
    )
    if stored is not None:
        parties = parties.unionByName(
            known_clients(mentions, stored).select(
                *CLIENT_KEY,
                "id",
                F.lit(-1).cast("bigint").alias("bill_id"),
                F.lit(0).alias("role"),
            )
        )
    by_identity = with_identity(parties).groupBy(*IDENTITY).agg(F.min("id").alias("party_id"))
    keyed = with_identity(mentions.select("bill_id", "role", *CLIENT_KEY))
    return keyed.join(by_identity, IDENTITY, "left").select("bill_id", "role", "party_id")


def bill_parties(ids: DataFrame) -> DataFrame:
    """Party ids per bill, one column for each role."""
    return ids.groupBy("bill_id").agg(
        F.max(F.when(F.col("role") == 1, F.col("party_id"))).alias("bill_party"),
        F.max(F.when(F.col("role") == 2, F.col("party_id"))).alias("ship_party"),
    )


def with_parties(bills: DataFrame, ids: DataFrame) -> DataFrame:
    """Bills with ``billed_to`` and ``shipped_to``; the same party gets the same id."""
    parties = bill_parties(ids)
    return (
        bills.join(parties, bills.id == parties.bill_id, "left")
        .withColumn("billed_to", F.col("bill_party"))
        .withColumn(
            "shipped_to",
            F.when(same_party(), F.col("bill_party")).otherwise(F.col("ship_party")),
        )
        .drop("bill_id", "bill_party", "ship_party")
    )

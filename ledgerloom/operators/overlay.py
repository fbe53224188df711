"""Updates as overlays: the latest change per key replaces the stored value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_update(updates: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Last change per key, combined before the shuffle; an empty text is a legal value.

    Of changes with the same order the largest value counts.
    """
    newest = F.max(F.struct(F.col(order).alias("at"), F.col(value).alias("value")))
    return updates.groupBy(key).agg(newest.alias("_last")).select(
        key, F.col("_last.value").alias("_value")
    )


def overlay(base: DataFrame, updates: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Rows of ``base`` with ``value`` taken from the last update of their ``key``.

    Updates of unknown or NULL keys change nothing.
    """
    last = latest_update(
        updates.where(F.col(key).isNotNull() & F.col(value).isNotNull()), key, value, order
    )
    return (
        base.join(last, key, "left")
        .withColumn(value, F.coalesce("_value", value))
        .drop("_value")
    )


def effective_terms(companies: DataFrame, updates: DataFrame, defaults: DataFrame) -> DataFrame:
    """Terms per company after all updates, beside the default offered to new ones.

    The default is the first row of a one-row table.
    """
    changed = overlay(companies.select("id", "custTerms"), updates, "id", "custTerms", "seq")
    return changed.withColumn("default_terms", defaults.select("custTerms").limit(1).scalar())


def link_accounts(users: DataFrame, companies: DataFrame) -> DataFrame:
    """Accounts with the company they registered last."""
    links = companies.select(
        F.col("created_by").alias("id"), F.col("id").alias("company_id")
    )
    return overlay(users, links, "id", "company_id", "company_id")


def stored_updates(base: DataFrame, updates: DataFrame, entity: str, field: str) -> DataFrame:
    """Rows of ``base`` with the last logged value of ``field``, by batch and order in it.

    Values are logged as texts and take the type of the column.
    """
    mine = updates.where((F.col("entity") == entity) & (F.col("field") == field))
    mine = mine.where(F.col("key").isNotNull() & F.col("value").isNotNull())
    newest = F.max(F.struct("batch_id", "seq", "value")).alias("_last")
    last = mine.groupBy(F.col("key").alias("_key")).agg(newest)
    value = F.col("_last.value").cast(base.schema[field].dataType)
    return (
        base.join(last, F.col("id") == F.col("_key"), "left")
        .withColumn(field, F.coalesce(value, field))
        .drop("_key", "_last")
    )

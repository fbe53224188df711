"""Billing-ledger analytics for Spark: pricing, numbering, upserts and reports."""

"""Operators over the ledger: DataFrame in, DataFrame out."""

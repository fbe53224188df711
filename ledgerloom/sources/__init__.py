"""Readers and writers of ledger tables and submissions."""

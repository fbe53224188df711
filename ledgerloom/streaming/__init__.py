"""Arriving documents as micro-batches over the batch operators."""

"""Runs that combine operators, and the registered queries with their SQL twins."""

"""Queries on the test tables, each with its SQL oracle."""

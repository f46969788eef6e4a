"""Queries over the test tables, built of the operators."""

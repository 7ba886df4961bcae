"""Whole workflows composed from operators, and the queries over the test tables."""

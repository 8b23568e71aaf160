"""Queries over the test tables and the SQL that each of them must agree with."""

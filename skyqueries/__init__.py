"""Registered queries: each operator over the given tables, with the SQL that checks it."""

"""Queries composed from operators, the registry of queries and the SQL they are checked with."""

"""Registered queries: each applies an operator to the given tables; beside it stands its SQL."""

"""Registered queries: operators on fleet views of the given tables, with equivalent SQL."""

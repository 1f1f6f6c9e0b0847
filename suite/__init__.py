"""Registered queries over the test tables, each beside the SQL it must equal."""

from suite.registry import CASES, Tables

from suite import columns, counting, filters, io, quality, querylog, relational, scoring, text, vectors  # noqa: E402,F401,I001

__all__ = ["CASES", "Tables"]

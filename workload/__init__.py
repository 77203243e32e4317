"""Registered queries: each operator on whole driver tables, with an SQL oracle."""

from importlib import import_module

MODULES = ("risk", "gains", "special_uniques", "outliers", "mitigation", "tables", "wide", "variants")


def registered():
    """All queries by name."""
    found = {}
    for module in MODULES:
        found.update(import_module(f"workload.{module}").QUERIES)
    return found

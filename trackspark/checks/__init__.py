"""Queries that run the operators over the given tables, with SQL that must agree."""

import importlib

MODULES = ("expressions", "expansion", "targets", "calibration", "failure", "modelling", "matching", "sources", "quality", "plans")


def load():
    """Import all query modules and return the registry."""
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return importlib.import_module(f"{__name__}.registry")

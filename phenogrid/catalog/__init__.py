"""Queries over the test tables, one module per family of operators."""

from __future__ import annotations

import importlib

MODULES = ("scans", "filters", "gridding", "counts", "joins", "published", "places_months", "species_year", "rasters", "tilesets", "kb", "checks", "incremental", "changes", "verbs")


def load():
    """Import every query module and return the registry."""
    for module in MODULES:
        importlib.import_module(f"phenogrid.catalog.{module}")
    return importlib.import_module("phenogrid.catalog.registry")

"""Collects every registered query."""

from cinderline.plans import catalog_operators, catalog_studies, catalog_tables  # noqa: F401
from cinderline.plans.registry import ORACLES, QUERIES


def load():
    return QUERIES, ORACLES

"""Whole queries over the driver's tables, each with its SQL twin."""

from textmill.plans import catalogue, reports, scenarios

QUERIES = catalogue.QUERIES | reports.QUERIES | scenarios.QUERIES
ORACLES = catalogue.ORACLES | reports.ORACLES | scenarios.ORACLES | {"layout_report": scenarios.REPORT_SQL}

__all__ = ["ORACLES", "QUERIES"]

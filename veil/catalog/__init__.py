"""Every operator as a query over the sample tables, with SQL that says the same for another engine."""

from veil.catalog import audit, detectors, known, labels, records, redaction, scoring, streams  # noqa: F401
from veil.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

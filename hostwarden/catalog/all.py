"""Imports every catalog module, which registers its queries."""

from hostwarden.catalog import correlating, detection, enrichment, learning, monitoring, reporting, state, streams  # noqa: F401
from hostwarden.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

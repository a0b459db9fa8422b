"""Imports every query module and exposes the registry."""

from checks import expressions, ingest, retrieval, streams  # noqa: F401
from checks.registry import ORACLES, QUERIES  # noqa: F401

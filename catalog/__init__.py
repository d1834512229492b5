"""Registered queries: each operator over the driver's tables, with its SQL twin."""

from catalog import collect, text, dedup, sentiment, learn, curate, topics, reports  # noqa: F401
from catalog.registry import ORACLES, QUERIES  # noqa: F401

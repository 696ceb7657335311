"""Registered queries, each with the SQL that must give the same rows where SQL can."""

from . import cleaning, charting, encoding, features, issueset, modelling, profiling, sourcing, texts, transforms  # noqa: F401
from .common import ORACLES, QUERIES  # noqa: F401

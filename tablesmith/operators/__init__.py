"""Importing this package registers every step method."""

from . import balance, binning, clean, correlate, encode, impute, reduce, scale, select, text, timefeat, transform  # noqa: F401

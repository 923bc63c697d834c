"""Ledgerloom: evidence analytics for recorded work sessions, on Spark."""

__version__ = "0.1.0"

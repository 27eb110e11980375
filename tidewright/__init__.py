"""Tidewright: document, event-series and spatial analytics declared on Spark DataFrames."""

from tidewright.session import load, session

__all__ = ["load", "session"]

"""Distributed HDR/SDR frame analytics on PySpark."""

from .session import session

__all__ = ["session"]

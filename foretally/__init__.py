"""Leak-safe event-log analytics expressed as Spark DataFrame plans."""

from foretally.roles import Order

__all__ = ["Order"]

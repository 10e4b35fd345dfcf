"""Queries over the driver's tables, one module per operator family."""

from importlib import import_module

MODULES = ("eb_queries", "history_queries", "audit_queries", "score_queries", "profile_queries",
           "row_queries", "entity_queries")


def load_all() -> None:
    for name in MODULES:
        import_module(f"foretally.plans.{name}")

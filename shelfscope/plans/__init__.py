"""Registered queries by family."""

from importlib import import_module

FAMILIES = ["prices", "offers", "catalogue", "text", "matching", "jobs", "ledger", "refresh", "offer_sync"]


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")

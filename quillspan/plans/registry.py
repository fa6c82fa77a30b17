"""All queries of the core, by module."""

from importlib import import_module

MODULES = ["catalog", "text", "transcript", "nested", "reconcile", "events", "codec", "ledger", "formats", "replies"]


def collect(kind: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"quillspan.plans.{m}"), kind)
    return out

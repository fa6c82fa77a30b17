"""Queries of the training-data operators."""

from importlib import import_module

MODULES = ["survivor", "page_repair", "source_hygiene", "text_quality", "packing", "mixing", "subjects"]


def collect(kind: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"quillspan.llm.q_{m}"), kind)
    return out

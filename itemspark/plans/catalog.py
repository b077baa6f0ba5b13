"""Collects the query families; each module offers ``QUERIES`` and ``ORACLES`` keyed by name."""

from __future__ import annotations

from importlib import import_module
from pathlib import Path

FAMILIES = ("progress_queries", "selection_queries", "analytics_queries", "identity_queries",
            "reconcile_queries", "classify_queries", "quality_queries", "extract_queries",
            "grading_queries", "digest_queries", "source_queries", "stream_queries", "bank_queries")


def _collect(attr: str) -> dict:
    out: dict = {}
    for name in FAMILIES:
        if not (Path(__file__).parent / f"{name}.py").exists():
            continue
        part = getattr(import_module(f"itemspark.plans.{name}"), attr)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict:
    return _collect("ORACLES")

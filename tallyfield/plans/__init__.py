"""Registered queries: each operator on the test tables, with its SQL counterpart."""

from __future__ import annotations

import importlib

AREAS = ("purchases", "extracts", "cleaning", "clv", "draws", "experiments", "geo", "media",
         "uplift", "dml", "survival", "attribution", "policy", "quality", "streams")


def load():
    """Import every area and return the registry, in order."""
    from tallyfield.plans.registry import REGISTRY

    for area in AREAS:
        importlib.import_module(f"tallyfield.plans.{area}")
    return REGISTRY

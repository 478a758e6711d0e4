"""Registered queries: every operator on whole tables, with equivalent SQL where it exists."""

from uqframe.catalogue import (
    cleaning, diagnostics, features, models, neighbours, physics, reports, splits, surfaces,
    tables,
)

MODULES = (cleaning, features, splits, reports, diagnostics, physics, surfaces, neighbours,
           models, tables)


def registered() -> dict:
    """Query name -> (callable(spark, sf_dir), SQL or None)."""
    out: dict = {}
    for module in MODULES:
        for name, entry in module.QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} is registered twice")
            out[name] = entry
    return out

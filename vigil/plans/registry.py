"""All registered queries outside the corpus subpackage."""

from __future__ import annotations

from vigil.plans import evaluation, features, flows, investigation, lakes, lookups, model, pipeline, vendor

MODULES = (pipeline, features, investigation, evaluation, flows, model, vendor, lakes, lookups)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}

"""All queries of the library with their SQL, gathered from the query modules."""

from __future__ import annotations

FLAGSHIP = "rules_decision_counts"
_MODULES: list[str] = ["q_rules", "q_labels", "q_metrics", "q_data", "q_profile", "q_generate", "q_more"]


def _merged(name: str) -> dict:
    import importlib

    out: dict = {}
    for m in _MODULES:
        part = getattr(importlib.import_module(f"pairloom.queries.{m}"), name)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        out |= part
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")

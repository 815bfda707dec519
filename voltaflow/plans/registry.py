"""All registered queries of the time-series engine, with their SQL."""

from __future__ import annotations

from . import control_plans, dsp_plans, event_plans, folder_plans, path_plans, rei_plans, run_plans, scalar_plans, source_plans

FLAGSHIP = "rei_score"
MODULES = [rei_plans, event_plans, scalar_plans, dsp_plans, source_plans, run_plans, path_plans, control_plans, folder_plans]


def _all() -> dict:
    found: dict = {}
    for module in MODULES:
        for name, entry in module.QUERIES.items():
            if name in found:
                raise ValueError(f"{name} is registered twice")
            found[name] = entry
    return found


def queries() -> dict:
    return {name: fn for name, (fn, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}

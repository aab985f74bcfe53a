"""All registered queries."""

from importlib import import_module

from barloom.plans.registry import ORACLES, QUERIES

MODULES = ("q_bars", "q_technical", "q_flow", "q_samples", "q_reference", "q_news", "q_signals", "q_sources", "q_edges", "q_landed")

for _m in MODULES:
    import_module(f"barloom.plans.{_m}")

__all__ = ["ORACLES", "QUERIES"]

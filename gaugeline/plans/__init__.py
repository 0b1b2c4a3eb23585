"""Registered queries by theme. Importing a module here registers its queries."""

from importlib import import_module

THEMES = ("envelope", "windows", "alarm", "evaluation", "quality", "network", "ingest", "records", "latency", "modelling", "streams")


def load_all() -> None:
    for theme in THEMES:
        import_module(f"gaugeline.plans.{theme}")

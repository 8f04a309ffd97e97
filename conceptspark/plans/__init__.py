"""Registered queries, one module per section of the survey."""

import importlib

MODULES = [
    "graphs", "features", "topology", "texts", "labels", "evaluation", "reports", "vocabulary", "storage", "learning",
]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"conceptspark.plans.{name}")

"""Query modules of the core: each has QUERIES and ORACLES."""

import importlib

#: In the order they are listed.
NAMES = ("pipeline", "analytics", "search", "relational", "library")


def core_modules() -> list:
    return [importlib.import_module(f"sheafline.plans.{n}") for n in NAMES]

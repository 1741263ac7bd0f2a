"""Operators for training data, with their queries and SQL.  Nothing else imports this package."""

import importlib

NAMES = ("q_knn", "q_markup", "q_near", "q_scan", "q_mail", "q_leak", "q_mix", "q_pii")


def modules() -> list:
    return [importlib.import_module(f"sheafline.llm.{n}") for n in NAMES]

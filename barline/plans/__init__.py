"""Registered queries: each applies operators to the market tables; most have SQL that states the same result."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("bars", "joined", "market", "flowing", "portfolios")


def _joined(name: str) -> dict:
    out: dict = {}
    for module in _MODULES:
        out |= getattr(import_module(f"barline.plans.{module}"), name)
    return out


def queries() -> dict:
    return _joined("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _joined("ORACLE_SQL")

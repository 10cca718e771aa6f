"""Every registered query, with the SQL that must give the same rows."""

from __future__ import annotations

from . import inference, operations, parsing

_MODULES = [parsing, operations, inference]


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}

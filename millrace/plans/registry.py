"""Name, query and DuckDB twin of each operator."""

from __future__ import annotations

from . import evaluation, paragraphs, samples, shaping

_MODULES = (paragraphs, evaluation, shaping, samples)


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.queries().items()}


def oracles() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.oracles().items()}

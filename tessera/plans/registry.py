"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("feed", "texts", "windows", "domain", "records", "frames")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES

"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("sharding", "decontaminate", "perspectives", "near_dedup", "line_spread", "host_rules", "notice_scan", "main_text", "quality_gam", "piece_lattice")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES

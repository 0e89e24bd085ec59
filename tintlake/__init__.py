"""Analytics over hard-coded style values, on PySpark. The main names are loaded when they are first asked for."""

from __future__ import annotations

import importlib
from typing import Any

_NAMES = {
    "Config": "plans.config", "load": "plans.config", "run": "plans.workspace", "generate": "plans.workspace", "read_lock": "plans.workspace", "write_lock": "plans.workspace",
    "read_workspace": "sources.workspace", "incremental": "sources.workspace", "occurrences": "sources.stylesheet", "watch": "streaming.watch",
    "clusters": "operators", "composites": "operators", "lock": "operators", "naming": "operators", "review": "operators", "rewriting": "operators", "sinks": "operators", "themes": "operators", "typos": "operators",
    "color": "functions", "names": "functions", "values": "functions",
}
__all__ = list(_NAMES)


def __getattr__(name: str) -> Any:
    if name not in _NAMES:
        raise AttributeError(name)
    home = _NAMES[name]
    if home in ("operators", "functions"):
        return importlib.import_module(f"tintlake.{home}.{name}")
    return getattr(importlib.import_module(f"tintlake.{home}"), name)

"""Settings in layers: defaults, user, workspace, project file. A layer's bad values are named and left out."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from tintlake.functions.values import CATEGORIES
from tintlake.operators.themes import DARK
from tintlake.sources.workspace import EXCLUDE, INCLUDE, output_excludes

FORMATS = ("css", "scss", "json-dtcg", "tokens-studio", "stylelint", "docs")
CASES = ("kebab", "camel", "pascal", "snake")
#: Names of categories as people write them.
ALIASES = {"zindex": ["z-index"], "fontsize": ["font-size"], "fontfamily": ["font-family"], "fontweight": ["font-weight"], "lineheight": ["line-height"], "letterspacing": ["letter-spacing"], "typography": ["typography", "font-family", "font-size", "font-weight", "line-height", "letter-spacing"]}


@dataclass(frozen=True)
class Config:
    include: tuple[str, ...] = INCLUDE
    exclude: tuple[str, ...] = EXCLUDE
    categories: tuple[str, ...] = CATEGORIES
    formats: tuple[str, ...] = ("css", "scss", "json-dtcg", "tokens-studio")
    output: str = "design-tokens"
    case: str = "kebab"
    prefix: str = ""
    color_delta_e: float = 2.0
    spacing_tolerance_rem: float = 0.01
    min_occurrences: float = 1
    dark_markers: tuple[str, ...] = DARK
    composite_mode: str = "whole-value"

    def excludes(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*self.exclude, *output_excludes(self.output, f"{self.output}/.backups")]))


@dataclass
class Layered:
    config: Config = field(default_factory=Config)
    warnings: list[str] = field(default_factory=list)

    def add(self, name: str, layer: Any) -> None:
        """Puts a layer of plain values on top."""
        if not isinstance(layer, dict):
            self.warnings.append(f"{name}: not an object")
            return
        for key, value in layer.items():
            if key not in Config.__dataclass_fields__:
                self.warnings.append(f"{name}: {key} is not a setting")
            elif (good := checked(key, value)) is None:
                self.warnings.append(f"{name}: {key} has a value that can't be used: {value!r}")
            else:
                self.config = replace(self.config, **{key: good})


def checked(key: str, value: Any) -> Any:
    """The value in its own type, or None."""
    texts = tuple(value) if isinstance(value, list | tuple) and all(isinstance(v, str) and v for v in value) else None
    number = float(value) if isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value) else None
    if key == "categories":
        found = [c for v in texts or () for c in ALIASES.get(v.lower(), [v.lower()])]
        return tuple(dict.fromkeys(found)) if found and set(found) <= set(CATEGORIES) else None
    if key == "formats":
        return texts if texts and set(texts) <= set(FORMATS) else None
    if key in ("include", "exclude", "dark_markers"):
        return texts
    if key in ("color_delta_e", "spacing_tolerance_rem"):
        return number if number is not None and number >= 0 else None
    if key == "min_occurrences":
        return number if number is not None and number >= 1 else None
    if key == "case":
        return value if value in CASES else None
    if key == "composite_mode":
        return value if value in ("whole-value", "component") else None
    return value.strip() if isinstance(value, str) and (key == "prefix" or value.strip()) else None


def load(path: str | None, *layers: tuple[str, Any]) -> Layered:
    """Defaults, the layers in order, then the project file. A missing file is no fault; a broken one is named."""
    out = Layered()
    for name, layer in layers:
        out.add(name, layer)
    if path and Path(path).exists():
        try:
            out.add(path, json.loads(Path(path).read_text(encoding="utf-8")))
        except ValueError as e:
            out.warnings.append(f"{path}: {e}")
    return out

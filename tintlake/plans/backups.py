"""Bundles of sources as they were before a plan changed them."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

MANIFEST = "manifest.json"


@dataclass(frozen=True)
class Bundle:
    folder: Path
    created_at: str
    files: tuple[str, ...]


def write_bundle(home: Path, sources: Iterable[tuple[str, str]], now: str) -> Bundle:
    """Writes each file below a folder of its own time, and a manifest of them last, so that a bundle with one is whole."""
    folder, names = home / now.replace(":", "-").replace(".", "-"), []
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in sources:
        path = folder / "files" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
        names.append(name)
    (folder / MANIFEST).write_text(json.dumps({"created_at": now, "files": names}, indent=1), encoding="utf-8")
    return Bundle(folder, now, tuple(names))


def bundles(home: Path) -> list[Bundle]:
    """The whole bundles, the newest first."""
    out = []
    for folder in sorted(home.iterdir() if home.is_dir() else (), key=lambda p: p.name, reverse=True):
        try:
            held = json.loads((folder / MANIFEST).read_text(encoding="utf-8"))
            out.append(Bundle(folder, held.get("created_at", folder.name), tuple(held.get("files", ()))))
        except (OSError, ValueError, AttributeError):
            continue  # not a whole bundle
    return out


def restore(bundle: Bundle, root: Path) -> list[str]:
    """Puts a bundle's files back and says which."""
    for name in bundle.files:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text((bundle.folder / "files" / name).read_text(encoding="utf-8"), encoding="utf-8")
    return list(bundle.files)

"""Configuration and provenance. Plain Python: there is no data here."""

from __future__ import annotations

import os
import re
import subprocess
import tomllib
from dataclasses import dataclass
from pathlib import Path


class ConfigError(ValueError):
    """A setting that is missing or can't be used."""


@dataclass(frozen=True)
class Config:
    engine: Path
    out: Path

    @property
    def merged_graph(self) -> Path:
        return self.out / "merged" / "graph.json"

    def chunk_graph(self, name: str) -> Path:
        return self.out / name / "graph.json"


#: The settings' names in the environment and in the file.
SETTINGS = {"engine": "KNOTWORK_ENGINE", "out": "KNOTWORK_OUT"}


def load(folder: Path, engine: str | None = None, out: str | None = None, markers: tuple[str, ...] = ()) -> Config:
    """Arguments win over the environment, that over knotwork.toml in the folder, that over looking upwards for the markers."""
    path = folder / "knotwork.toml"
    filed = tomllib.loads(path.read_text(encoding="utf-8")) if path.exists() else {}
    given = {"engine": engine, "out": out}
    found = {k: given[k] or os.environ.get(v) or filed.get(k) for k, v in SETTINGS.items()}
    if not found["engine"] and markers:
        found["engine"] = next((str(p) for p in (folder, *folder.parents) if all((p / m).exists() for m in markers)), None)
    if not found["engine"]:
        raise ConfigError("no engine checkout: pass it, set KNOTWORK_ENGINE or write knotwork.toml")
    root = Path(found["engine"]).expanduser().resolve()
    if missing := [m for m in markers if not (root / m).exists()]:
        raise ConfigError(f"{root} is no engine checkout: it lacks {', '.join(missing)}")
    return Config(root, Path(found["out"]).expanduser().resolve() if found["out"] else folder / "knotwork-out")


def _git(engine: Path, *arguments: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", str(engine), *arguments], capture_output=True, text=True, timeout=30, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() or None if done.returncode == 0 else None


def _head(engine: Path) -> str | None:
    """The commit, read from .git where there is no git to ask."""
    head = engine / ".git" / "HEAD"
    if not head.is_file():
        return None
    text = head.read_text().strip()
    if not text.startswith("ref: "):
        return text or None
    ref, packed = engine / ".git" / text[5:], engine / ".git" / "packed-refs"
    if ref.is_file():
        return ref.read_text().strip() or None
    found = re.search(rf"(?m)^([0-9a-f]+) {re.escape(text[5:])}$", packed.read_text()) if packed.is_file() else None
    return found[1] if found else None


#: Fixed value: the file whose first line names the release.
NEWS = "News.txt"


def provenance(engine: Path, news: str = NEWS, version_file: str | None = None, define: str | None = None) -> dict[str, str | None]:
    """commit, describe, release (the first line of the news) and version (of ``#define NAME "x"``), each independent of the others."""
    first = (engine / news).read_text(errors="ignore").split("\n", 1)[0].rstrip().rstrip(":").strip() if (engine / news).is_file() else None
    text = (engine / version_file).read_text(errors="ignore") if version_file and (engine / version_file).is_file() else ""
    found = re.search(rf'(?m)^\s*#\s*define\s+{re.escape(define)}\s+"([^"]*)"', text) if define else None
    return {"commit": _git(engine, "rev-parse", "HEAD") or _head(engine), "describe": _git(engine, "describe", "--tags", "--always"), "release": first or None, "version": found[1] if found else None}

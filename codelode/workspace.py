"""Scopes: which project a folder belongs to. All of it is configuration, read on the driver."""

from __future__ import annotations

import json
import os
import posixpath
from dataclasses import dataclass, field

MARKERS = [".git", "go.mod", "package.json", "pyproject.toml", "Cargo.toml"]


@dataclass
class Scope:
    name: str
    workspace_root: str = ""
    primary_root: str = ""
    roots: list[str] = field(default_factory=list)
    workspace_type: str = "single"

    def title(self) -> str:
        return self.name if self.name.strip() else "current project"


def normalize_project_name(name: str) -> str:
    """Letters and digits made small, ``-_.`` kept, all else ``-``; ``default`` if nothing is left."""
    kept = "".join(c.lower() if c.isalpha() or c.isdigit() else c if c in "-_." else "-" for c in name.strip())
    return kept.strip("-.") or "default"


def project_name_of(folder: str) -> str:
    """The base name of a folder; ``default`` for the root."""
    base = os.path.basename(os.path.abspath(folder))
    return "default" if base in ("", "/", ".") else base


def parse_changed(text: str) -> list[str]:
    """A list of paths between commas."""
    return [p.strip() for p in text.split(",") if p.strip()]


def resolve_changed(path: str, root: str) -> str:
    """An absolute path; relative ones lie below the root."""
    return posixpath.normpath(path if posixpath.isabs(path) else posixpath.join(root, path))


def within_roots(path: str, roots: list[str]) -> bool:
    return any(path == r or path.startswith(r.rstrip("/") + "/") for r in roots)


def _ancestor(start: str, names: list[str]) -> str | None:
    at = os.path.abspath(start)
    if not os.path.isdir(at):
        at = os.path.dirname(at)
    while True:
        if any(os.path.exists(os.path.join(at, n)) for n in names):
            return at
        up = os.path.dirname(at)
        if up == at:
            return None
        at = up


def nx_projects(root: str) -> list[tuple[str, str]]:
    """``name, folder`` of every ``project.json`` below the root, by name; the last one walked counts; broken ones are skipped."""
    found: dict[str, str] = {}
    for folder, dirs, files in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in ("node_modules", ".git"))
        if "project.json" not in files:
            continue
        try:
            with open(os.path.join(folder, "project.json")) as f:
                data = json.load(f)
        except (OSError, ValueError):
            continue
        place = str(data.get("root") or "").strip() or os.path.relpath(folder, root)
        name = str(data.get("name") or "").strip() or posixpath.basename(place)
        found[name] = os.path.normpath(os.path.join(root, place))
    return sorted(found.items())


def select_project(projects: list[tuple[str, str]], name: str, start: str) -> tuple[str, str]:
    """The project of that name; else the first by name that holds ``start``; else the only one."""
    if name:
        for project in projects:
            if project[0] == name:
                return project
        raise ValueError(f"no project named {name}")
    for project in sorted(projects):
        if within_roots(start, [project[1]]):
            return project
    if len(projects) == 1:
        return projects[0]
    raise ValueError("several projects: name one of " + ", ".join(sorted(p[0] for p in projects)))


def resolve_scope(path: str = ".", project: str = "") -> Scope:
    """The scope of a path: its Nx project, or the nearest folder that looks like a project's root."""
    start = os.path.abspath(path or ".")
    workspace = _ancestor(start, ["nx.json"])
    if workspace:
        projects = nx_projects(workspace)
        if projects:
            name, folder = select_project(projects, project.strip(), start)
            return Scope(normalize_project_name(name), workspace, folder, [folder], "nx")
    root = _ancestor(start, MARKERS) or (start if os.path.isdir(start) else os.path.dirname(start))
    return Scope(normalize_project_name(project_name_of(root)), root, root, [root])


def tool_scope(path: str = "", project: str = "") -> Scope:
    """As asked for by name, by path, or by the current folder."""
    if not path.strip() and project.strip():
        return Scope(normalize_project_name(project))
    return resolve_scope(path.strip() or ".", project)

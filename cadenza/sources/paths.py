"""What is wrong with paths, told before a job starts (driver side, local paths)."""

from __future__ import annotations

import os


def path_problem(path: str) -> str | None:
    """A sentence about a path that can't be read; null if it can."""
    if os.path.isdir(path):
        return f"{path} is a folder, not a file"
    if os.path.exists(path):
        return None
    parent = os.path.dirname(path) or "."
    if any(c in path for c in "*?["):
        return f"no file matches {path}"
    if not os.path.isdir(parent):
        return f"there is no folder {parent}"
    hint = "; is it meant as the output?" if path.lower().endswith(".gif") else ""
    return f"there is no file {path}{hint}"


def list_problem(names: list[str]) -> str | None:
    """Why a list of inputs can't be encoded; null if it can: one video, or two and more PNG files."""
    kinds = [os.path.splitext(n)[1].lower().lstrip(".") for n in names]
    if len(names) == 1:
        return "a single picture makes no clip" if kinds[0] in ("png", "jpg", "jpeg") else None
    bad = next((n for n, k in zip(names, kinds) if k in ("jpg", "jpeg", "gif", "y4m")), None)
    return f"{bad} can't be one of several files" if bad else None

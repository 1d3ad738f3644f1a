"""Paths as users give them on the command line."""

from __future__ import annotations

import os
import re

#: Stands for an input that is not given.
MISSING = "NA"


def user_path(path: str, base: str | None = None) -> str:
    """The path with ~ expanded and, if relative, taken from `base` (the folder the command was called from); NA and URIs stay."""
    if path == MISSING or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        return path
    return os.path.realpath(os.path.join(base or os.getcwd(), os.path.expanduser(path))) if not os.path.isabs(os.path.expanduser(path)) else os.path.expanduser(path)

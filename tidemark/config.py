"""Folders of artifacts; environment variables override the defaults."""

from __future__ import annotations

import os
from pathlib import Path

DEFAULTS = {"models": "models", "reports": "reports", "data": "data"}


def folder(kind: str, root: str | Path = ".") -> Path:
    """models, reports or data: $TIDEMARK_<KIND>_DIR if set, else a folder under root."""
    if kind not in DEFAULTS:
        raise KeyError(kind)
    return Path(os.environ.get(f"TIDEMARK_{kind.upper()}_DIR") or Path(root) / DEFAULTS[kind])

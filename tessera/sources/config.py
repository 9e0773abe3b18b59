"""Settings from TOML; keys that aren't known are refused."""

from __future__ import annotations

import tomllib
from pathlib import Path

CLIENT = {"roots": list, "owner": str, "store": str, "target_size": (int, str), "policy": str, "interval": str, "jitter": (int, float)}
STORE = {"path": str, "auto_prune": bool, "grace": str, "tiers": list}


def load(path: str, known: dict) -> dict:
    """The settings of a file; a missing file has none."""
    if not Path(path).exists():
        return {}
    got = tomllib.loads(Path(path).read_text())
    for key, value in got.items():
        if key not in known:
            raise ValueError(f"unknown key {key}")
        if not isinstance(value, known[key]):
            raise ValueError(f"{key} has the wrong kind")
    return got

"""Settings of a run in layers: defaults, then pyproject.toml, then a YAML or JSON file, then the environment."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Mapping
from pathlib import Path

DEFAULTS = {"profile": "all", "severity": "info", "rules": [], "exclude": [], "fail_on": "high", "limits": {"taint_rounds": 50, "lock_depth": 5}}


def merged(base: Mapping, over: Mapping) -> dict:
    """base with over laid on it; mappings merge, all else is replaced."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


def load(folder: str, tool: str = "siftlake", environment: Mapping[str, str] | None = None) -> dict:
    """The settings for a folder. Missing files are empty layers; a variable SIFTLAKE_A__B sets a.b, as JSON if it is JSON."""
    out = dict(DEFAULTS)
    project = Path(folder, "pyproject.toml")
    if project.exists():
        out = merged(out, tomllib.loads(project.read_text()).get("tool", {}).get(tool, {}))
    for name in (f".{tool}.yaml", f".{tool}.yml", f".{tool}.json"):
        if Path(folder, name).exists():
            text = Path(folder, name).read_text()
            if name.endswith("json"):
                out = merged(out, json.loads(text))
            else:
                import yaml

                out = merged(out, yaml.safe_load(text) or {})
    for key, value in sorted((os.environ if environment is None else environment).items()):
        if key.startswith(tool.upper() + "_"):
            try:
                value = json.loads(value)
            except ValueError:
                pass
            layer: object = value
            for step in reversed(key[len(tool) + 1 :].lower().split("__")):
                layer = {step: layer}
            out = merged(out, layer)
    return out

"""Layered settings: defaults, a profile with `extends`, a user's own, and environment variables QM_A__B=value."""

from __future__ import annotations

import json
import logging
import os
from copy import deepcopy

log = logging.getLogger("quillmill.config")

DEFAULTS = {
    "llm": {"url": "http://127.0.0.1:8080", "timeout": 300, "temperature": 0.7, "top_p": 0.9, "max_tokens": 1024},
    "validation": {"instruction": [10, 5000], "response": [20, 10000]},
    "deduplication": {"threshold": 0.85},
    "storage": {"base_path": "datasets"},
}


def merged(base: dict, over: dict) -> dict:
    out = deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


def _yaml():
    try:
        import yaml
    except ModuleNotFoundError as e:
        raise RuntimeError("settings in YAML need the yaml module; JSON needs none") from e
    return yaml


def read_file(path: str) -> dict:
    """Settings of a JSON or YAML file; none, with a warning, if it is missing or isn't a mapping."""
    parse, bad = (json.loads, ValueError) if path.endswith(".json") else (_yaml().safe_load, _yaml().YAMLError)
    try:
        with open(path, encoding="utf-8") as f:
            found = parse(f.read())
    except (OSError, bad) as e:
        log.warning("no settings from %s: %s", path, e)
        return {}
    if found is not None and not isinstance(found, dict):
        log.warning("no settings from %s: not a mapping", path)
    return found if isinstance(found, dict) else {}


class Config:
    """user: settings, or the path of a file of them."""

    def __init__(self, profiles: dict[str, dict] | None = None, profile: str | None = None, user: dict | str | None = None, environ: dict | None = None):
        layers, name = [], profile
        while name:
            layer = dict((profiles or {})[name])
            name = layer.pop("extends", None)
            layers.append(layer)
        self.data = deepcopy(DEFAULTS)
        for layer in [*reversed(layers), read_file(user) if isinstance(user, str) else user or {}]:
            self.data = merged(self.data, layer)
        for k, v in (os.environ if environ is None else environ).items():
            if k.startswith("QM_"):
                try:
                    v = json.loads(v)
                except ValueError:
                    pass
                self.set(k[3:].lower().replace("__", "."), v)

    def get(self, path: str, default=None):
        at = self.data
        for k in path.split("."):
            if not isinstance(at, dict) or k not in at:
                return default
            at = at[k]
        return at

    def set(self, path: str, value) -> None:
        *above, last = path.split(".")
        at = self.data
        for k in above:
            at = at.setdefault(k, {})
        at[last] = value

    def save(self, path: str) -> None:
        """All settings in force, as JSON or YAML by the suffix."""
        with open(path, "w", encoding="utf-8") as f:
            f.write(json.dumps(self.data, indent=2) if path.endswith(".json") else _yaml().safe_dump(self.data))

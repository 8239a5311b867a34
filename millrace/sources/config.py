"""Nested settings from JSON or YAML text, with ${VARIABLE} replaced and dotted access."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from typing import Any


def substitute(value: Any, env: Mapping[str, str] | None = None) -> Any:
    """Texts with ${NAME} or ${NAME:default} replaced, through mappings and lists."""
    names = os.environ if env is None else env
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)(?::([^}]*))?\}", lambda m: names.get(m[1], m[2] if m[2] is not None else m[0]), value)
    if isinstance(value, Mapping):
        return {k: substitute(v, names) for k, v in value.items()}
    return [substitute(v, names) for v in value] if isinstance(value, list) else value


class Settings:
    """Nested settings with dotted names."""

    def __init__(self, values: Mapping[str, Any] | None = None):
        self.values: dict[str, Any] = dict(values or {})

    @classmethod
    def load(cls, path: str, env: Mapping[str, str] | None = None) -> Settings:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            return cls(substitute(yaml.safe_load(text) or {}, env))
        return cls(substitute(json.loads(text or "{}"), env))

    def get(self, name: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in name.split("."):
            if not isinstance(at, Mapping) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, name: str, value: Any) -> None:
        *parents, last = name.split(".")
        at = self.values
        for part in parents:
            at = at.setdefault(part, {})
        at[last] = value

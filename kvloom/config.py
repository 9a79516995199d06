"""Settings from a file of nested maps, looked up by dotted names. JSON always works, YAML where its reader is installed."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

try:
    import yaml
except ImportError:
    yaml = None

_NONE = object()


class Config:
    def __init__(self, values: dict | None = None) -> None:
        self.values = values or {}

    @classmethod
    def load(cls, path: str | Path) -> Config:
        text = Path(path).read_text(encoding="utf-8")
        return cls(yaml.safe_load(text) if yaml else json.loads(text))

    def get(self, name: str, default: Any = _NONE) -> Any:
        """The value at a dotted name, of the default's type if one is given: where there is none of that type, the default.

        Without a default, a name that is not there is a KeyError.
        """
        node: Any = self.values
        for part in name.split("."):
            if not isinstance(node, dict) or part not in node:
                if default is _NONE:
                    raise KeyError(name)
                return default
            node = node[part]
        if default is _NONE or default is None or isinstance(node, type(default)) and isinstance(node, bool) == isinstance(default, bool):
            return node
        try:
            return default if isinstance(node, (dict, list, bool)) or isinstance(default, (dict, list, bool)) else type(default)(node)
        except (TypeError, ValueError):
            return default

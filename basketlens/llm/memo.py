"""A bounded store of results that are asked for again and again."""

from __future__ import annotations

from typing import Any


class Memo:
    """Keeps what was used among the last ``size`` to ``2 * size`` different keys."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key: Any) -> Any:
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key: Any, value: Any) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value

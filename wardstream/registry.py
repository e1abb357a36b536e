"""Named readers, transforms and tools."""

from __future__ import annotations

from collections.abc import Callable, Iterator


class Registry:
    """Unique names for functions; an unknown name lists what there is."""

    def __init__(self, kind: str):
        self.kind, self._held = kind, {}

    def register(self, name: str, function: Callable | None = None) -> Callable:
        if function is None:
            return lambda f: self.register(name, f)
        if name in self._held:
            raise ValueError(f"{self.kind} {name!r} is registered already")
        self._held[name] = function
        return function

    def get(self, name: str) -> Callable | None:
        return self._held.get(name)

    def get_or_raise(self, name: str) -> Callable:
        if name not in self._held:
            raise KeyError(f"no {self.kind} {name!r}; there are: {', '.join(sorted(self._held))}")
        return self._held[name]

    def keys(self) -> list[str]:
        return sorted(self._held)

    def items(self) -> Iterator[tuple[str, Callable]]:
        return iter(sorted(self._held.items()))


readers = Registry("reader")
connectors = Registry("connector")
tools = Registry("tool")

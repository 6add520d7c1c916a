"""Name to function registries: estimators, losses, scorers, tools."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """A named set of functions; a name can be given again only to the same function."""

    def __init__(self, what: str):
        self.what, self._held = what, {}

    def register(self, *names: str) -> Callable:
        def add(f):
            for name in names or (f.__name__,):
                if self._held.get(name, f) is not f:
                    raise ValueError(f"{self.what} {name!r} is registered already")
                self._held[name] = f
            return f

        return add

    def get(self, name: str) -> Callable:
        if name not in self._held:
            raise ValueError(f"unknown {self.what} {name!r}; known: {', '.join(sorted(self._held))}")
        return self._held[name]

    def names(self) -> list[str]:
        return sorted(self._held)


ESTIMATORS = Registry("advantage estimator")
LOSSES = Registry("policy loss")
SCORERS = Registry("scorer")
TOOLS = Registry("tool")
TOOL_PARSERS = Registry("tool parser")
REWARD_MANAGERS = Registry("reward manager")

"""Which decoders and rules run, and in which order."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from . import decoders, detect


class Registry:
    """Named functions of a DataFrame: they can be added, disabled, enabled and put in order. Where a name is registered anew, the last one holds."""

    def __init__(self, known: dict[str, Callable[..., DataFrame]], disabled: tuple[str, ...] = ()) -> None:
        self._known, self._disabled = dict(known), set(disabled)

    def register(self, name: str, function: Callable[..., DataFrame], first: bool = False) -> None:
        self._known.pop(name, None)
        self._known = {name: function} | self._known if first else self._known | {name: function}

    def _must_know(self, name: str) -> None:
        if name not in self._known:
            raise KeyError(f"{name} is not registered")

    def disable(self, name: str) -> None:
        self._must_know(name)
        self._disabled.add(name)

    def enable(self, name: str) -> None:
        self._must_know(name)
        self._disabled.discard(name)

    def listed(self) -> list[tuple[str, bool]]:
        """(name, enabled) in order."""
        return [(n, n not in self._disabled) for n in self._known]

    def names(self) -> list[str]:
        return [n for n, enabled in self.listed() if enabled]

    def run(self, df: DataFrame) -> DataFrame:
        """The rows of all enabled functions, one after the other."""
        if not self.names():
            raise ValueError("nothing is enabled")
        return reduce(DataFrame.unionByName, [self._known[n](df) for n in self.names()])


def protocol_registry() -> Registry:
    return Registry(decoders.DECODERS)


def rule_registry() -> Registry:
    """All rules; those that aren't core are disabled."""
    return Registry(detect.RULES, tuple(n for n in detect.RULES if n not in detect.CORE))

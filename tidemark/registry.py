"""Named extensions: predicates of slices, feature families and scorers, checked when they are registered."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import TypeVar

Function = TypeVar("Function", bound=Callable)

#: Parameters of each kind: a predicate takes the roles and gives a condition over a slice's rows; a family takes the
#: roles and gives named aggregates of a window's rows; a scorer takes a table split in time and the scored columns and
#: gives the table with one more column, named as the scorer is.
KINDS = {"predicate": ("roles",), "family": ("roles",), "scorer": ("split", "columns")}
_known: dict[str, dict[str, Callable]] = {k: {} for k in KINDS}


def register(kind: str, name: str) -> Callable[[Function], Function]:
    """Registers a function under a name; raises if the name is taken, or if the function can't be called with just the
    kind's parameters, by position."""
    if kind not in KINDS:
        raise ValueError(f"no such kind: {kind}; there are {', '.join(KINDS)}")

    def add(f: Function) -> Function:
        if name in _known[kind]:
            raise ValueError(f"{kind} {name} is registered already")
        try:
            inspect.signature(f).bind(*KINDS[kind])
        except TypeError as e:
            raise TypeError(f"{kind} {name} must take ({', '.join(KINDS[kind])}): {e}") from e
        _known[kind][name] = f
        return f

    return add


def unregister(kind: str, name: str) -> None:
    del _known[kind][name]


def get(kind: str, name: str) -> Callable:
    try:
        return _known[kind][name]
    except KeyError:
        raise KeyError(f"no {kind} named {name}; there are {', '.join(sorted(_known[kind])) or 'none'}") from None


def registered(kind: str) -> dict[str, Callable]:
    """Functions of a kind by name, in the order in which they were registered."""
    return dict(_known[kind])

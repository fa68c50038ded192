"""Bind parameters put into a statement as data, never as text."""

from __future__ import annotations

import dataclasses
from typing import Any

from ..errors import MissingParameter
from . import ast as a


def bind(node: Any, values: list) -> Any:
    """The statement with $n replaced. In predicates a text that is a number's own spelling becomes that number."""
    return _bind(node, values, False)


def _value(p: a.Param, values: list, compared: bool) -> a.Value:
    if not 1 <= p.number <= len(values):
        raise MissingParameter(f"no value specified for parameter ${p.number}")
    v = values[p.number - 1]
    if v is None:
        return a.Null()
    if isinstance(v, str) and compared:
        for kind in (int, float):
            try:
                if str(kind(v)) == v:
                    return kind(v)
            except ValueError:
                pass
    return v


def _bind(node: Any, values: list, compared: bool) -> Any:
    if isinstance(node, a.Param):
        return _value(node, values, compared)
    if isinstance(node, tuple):
        return tuple(_bind(x, values, compared) for x in node)
    if dataclasses.is_dataclass(node):
        inside = compared or isinstance(node, (a.Compare, a.InList, a.Select))
        return dataclasses.replace(node, **{f.name: _bind(getattr(node, f.name), values, inside) for f in dataclasses.fields(node)})
    return node


def unbound(node: Any) -> int | None:
    """The number of some parameter that is still open."""
    if isinstance(node, a.Param):
        return node.number
    if isinstance(node, tuple):
        return next((n for x in node if (n := unbound(x)) is not None), None)
    if dataclasses.is_dataclass(node):
        return next((n for f in dataclasses.fields(node) if (n := unbound(getattr(node, f.name))) is not None), None)
    return None

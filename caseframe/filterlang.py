"""The filter language: ``column operator argument``, joined with and/or and brackets.

Terms are bare words or quoted texts with the usual escapes. A text becomes a small tree; :func:`to_column` makes it one
native Column over bound column types, :func:`to_function` a Python predicate over row dicts (for tests and row filters).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class FilterError(ValueError):
    """A filter text that can't be read or names something unknown."""


@dataclass(frozen=True)
class Test:
    column: str
    operator: str
    argument: str


@dataclass(frozen=True)
class Both:
    left: Node
    right: Node


@dataclass(frozen=True)
class Either:
    left: Node
    right: Node


Node = Test | Both | Either
_TOKEN = re.compile(r"""\s*(?:(?P<open>\()|(?P<close>\))|(?P<quoted>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<word>[^\s()"']+))""", re.S)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FilterError(f"unreadable at {text[at:at + 20]!r}")
        kind = m.lastgroup
        value = m.group(kind)
        out.append((kind, ast.literal_eval(value.replace("\n", "\\n")) if kind == "quoted" else value))
        at = m.end()
    return out


def parse(text: str, precedence: bool = True) -> Node | None:
    """The tree of a filter text, None for a blank one. ``precedence`` makes ``and`` bind tighter, else both are folded from
    the left and must be in lower case (the two readings that exist of this language)."""
    toks = tokens(text)
    if not toks:
        return None
    at = 0

    def peek() -> tuple[str, str]:
        return toks[at] if at < len(toks) else ("end", "")

    def take(*kinds: str) -> str:
        nonlocal at
        kind, value = peek()
        if kind not in kinds:
            raise FilterError(f"expected {' or '.join(kinds)}, found {value or 'the end'!r}")
        at += 1
        return value

    def joiner(*words: str) -> bool:
        kind, value = peek()
        return kind == "word" and (value.lower() if precedence else value) in words

    def primary() -> Node:
        if peek()[0] == "open":
            take("open")
            inner = whole()
            take("close")
            return inner
        return Test(take("word", "quoted"), take("word"), take("word", "quoted"))

    def conjunction() -> Node:
        node = primary()
        while joiner("and"):
            take("word")
            node = Both(node, primary())
        return node

    def whole() -> Node:
        if precedence:
            node = conjunction()
            while joiner("or"):
                take("word")
                node = Either(node, conjunction())
            return node
        node = primary()
        while joiner("and", "or"):
            node = (Both if take("word") == "and" else Either)(node, primary())
        return node

    tree = whole()
    if at < len(toks):
        raise FilterError(f"expected and/or, found {peek()[1]!r}")
    return tree


def columns_of(node: Node | None) -> list[str]:
    """Names of the columns that a tree tests, in order, each once."""
    if node is None:
        return []
    found = [node.column] if isinstance(node, Test) else columns_of(node.left) + columns_of(node.right)
    return list(dict.fromkeys(found))


def _bound(types: Mapping, name: str):  # noqa: ANN202
    got = types.get(name)
    return got if got is not None else next((t for k, t in types.items() if k.lower() == name.lower()), None)


def to_column(node: Node | None, types: Mapping, unknown: str = "error") -> Column:
    """One Column over ``types`` (name to column type). ``unknown``: a test of an unknown column is an ``error`` or ``true``."""
    if node is None:
        return F.lit(True)
    if isinstance(node, Both):
        return to_column(node.left, types, unknown) & to_column(node.right, types, unknown)
    if isinstance(node, Either):
        return to_column(node.left, types, unknown) | to_column(node.right, types, unknown)
    kind = _bound(types, node.column)
    if kind is None:
        if unknown == "true":
            return F.lit(True)
        raise FilterError(f"no column {node.column!r}")
    return kind.test(node.operator, node.argument)


def to_function(node: Node | None, types: Mapping) -> Callable[[Mapping], bool]:
    """A predicate over dicts of native values by column name; a null value passes no test."""
    if node is None:
        return lambda row: True
    if isinstance(node, Both):
        a, b = to_function(node.left, types), to_function(node.right, types)
        return lambda row: a(row) and b(row)
    if isinstance(node, Either):
        a, b = to_function(node.left, types), to_function(node.right, types)
        return lambda row: a(row) or b(row)
    kind = _bound(types, node.column)
    if kind is None:
        raise FilterError(f"no column {node.column!r}")
    check = kind.row_test(node.operator, node.argument)
    return lambda row: (v := row.get(kind.name)) is not None and bool(check(v))

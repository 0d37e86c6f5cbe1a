"""Query strings to syntax trees: Boolean operators, phrases and proximity.

NOT binds closer than AND, AND closer than OR. ``"a b"`` is a phrase, ``#n(a, b)``
finds two words at most n apart. Operators are upper case. Operands that stand
side by side without an operator are joined by AND.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_LEX = re.compile(r'"[^"]*"|#\d+\(\s*[^\s(),]+\s*,\s*[^\s(),]+\s*\)|[()]|[^\s()]+')
_NEAR = re.compile(r"#(\d+)\(\s*([^\s(),]+)\s*,\s*([^\s(),]+)\s*\)")
WORD_LIMIT = 20


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Phrase:
    text: str


@dataclass(frozen=True)
class Near:
    distance: int
    left: str
    right: str


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Nothing:
    """Matches no document: an empty query or a missing operand."""


@dataclass(frozen=True)
class FreeText:
    """A ranked query; words past the limit are dropped."""

    words: tuple[str, ...]

    @staticmethod
    def of(words, limit: int = WORD_LIMIT) -> FreeText:
        return FreeText(tuple(words)[:limit])


def lex(query: str) -> list[str]:
    return _LEX.findall(query or "")


def parse(query: str, last_operand: bool = False):
    """The tree of a Boolean query; unbalanced brackets are forgiven. With
    ``last_operand``, of operands without an operator only the last counts."""
    tokens, at = lex(query), 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def either():
        nonlocal at
        left = both()
        while peek() == "OR":
            at += 1
            left = Or(left, both())
        return left

    def both():
        nonlocal at
        left = single()
        while (t := peek()) is not None and t not in ("OR", ")"):
            if t == "AND":
                at += 1
                left = And(left, single())
            else:
                left = single() if last_operand else And(left, single())
        return left

    def single():
        nonlocal at
        t = peek()
        if t is None or t in ("AND", "OR", ")"):
            return Nothing()
        at += 1
        if t == "NOT":
            return Not(single())
        if t == "(":
            inner = either()
            if peek() == ")":
                at += 1
            return inner
        if t.startswith('"'):
            return Phrase(t.strip('"'))
        if m := _NEAR.fullmatch(t):
            return Near(int(m[1]), m[2], m[3])
        return Term(t)

    if not tokens:
        return Nothing()
    tree = either()
    while at < len(tokens):  # a bracket closed too often
        at += 1
        if at < len(tokens):
            tree = And(tree, either())
    return tree


def leaves(tree) -> list:
    """Terms, phrases and proximity atoms of a tree, in order."""
    if isinstance(tree, (And, Or)):
        return leaves(tree.left) + leaves(tree.right)
    if isinstance(tree, Not):
        return leaves(tree.of)
    return [] if isinstance(tree, Nothing) else [tree]

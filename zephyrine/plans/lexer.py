"""Tokens of the dialect, and brackets among them."""

from __future__ import annotations

import re

TOKEN = re.compile(
    r"""\s+|--[^\n]*|(?P<s>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<q>`[^`]*`)|(?P<n>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?:[kKmMgG][bB]?\b)?)"""
    r"""|(?P<w>[A-Za-z_][\w$]*)|(?P<o>::|->|<>|!=|<=|>=|<<|>>|\|\||:=|[^\s])""",
    re.S,
)


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text): s string, q quoted name, n number, w word, o other."""
    out = []
    for m in TOKEN.finditer(text):
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
    return out


def closing(t: list, at: int) -> int:
    """Where the bracket that opens at ``at`` closes."""
    pair = {"(": ")", "[": "]", "{": "}"}
    stack = []
    for i in range(at, len(t)):
        x = t[i][1] if t[i][0] == "o" else ""
        if x in pair:
            stack.append(pair[x])
        elif stack and x == stack[-1]:
            stack.pop()
            if not stack:
                return i
    raise ValueError("a bracket is not closed")


def split(t: list, by: str = ",") -> list[list]:
    out, depth = [[]], 0
    for x in t:
        depth += (x[1] in "([{") - (x[1] in ")]}") if x[0] == "o" else 0
        if x == ("o", by) and not depth:
            out.append([])
        else:
            out[-1].append(x)
    return out if t else []


def text(t: list) -> str:
    return " ".join(x[1] for x in t)


def word(x: tuple, *names: str) -> bool:
    return x[0] == "w" and x[1].lower() in names

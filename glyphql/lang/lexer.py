"""Tokens of the symbolic language, each with its position."""

from __future__ import annotations

import re
from dataclasses import dataclass


class SyntaxProblem(ValueError):
    """A query that cannot be read; says where."""

    def __init__(self, message: str, text: str, at: int):
        line = text.count("\n", 0, at) + 1
        column = at - (text.rfind("\n", 0, at) + 1) + 1
        super().__init__(f"{message} (line {line}, column {column})")
        self.at = at


@dataclass(frozen=True)
class Token:
    kind: str  # word, number, span (7d), string, quoted, symbol, end
    text: str
    at: int
    end: int


_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)
      | (?P<string>'(?:[^']|'')*')
      | (?P<quoted>"(?:[^"]|"")*"|`[^`]*`)
      | (?P<span>\d+[dhmws]\b)
      | (?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
      | (?P<word>[^\W\d]\w*)
      | (?P<symbol>::|>>|<>|<=|>=|!=|==|&&|\|\||\#\#|[\[\](){},;+\-*/%=<>~^$|!@\#&?:.])
    """,
    re.X | re.S,
)


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise SyntaxProblem(f"unexpected character {text[at]!r}", text, at)
        if m.lastgroup != "skip":
            value = m.group()
            if m.lastgroup == "string":
                value = value[1:-1].replace("''", "'")
            elif m.lastgroup == "quoted":
                value = value[1:-1].replace('""', '"')
            out.append(Token(m.lastgroup, value, at, m.end()))
        at = m.end()
    out.append(Token("end", "", len(text), len(text)))
    return out

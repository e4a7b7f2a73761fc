"""Tokens of both languages."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import WeftError

_TOKEN = re.compile(
    r"(?P<skip>[ \t\r]+|//[^\n]*)|(?P<newline>\n)|(?P<string>\"(?:[^\"\\]|\\.)*\")|(?P<number>-?\d+(?:\.\d+)?)"
    r"|(?P<param>\$[A-Za-z_]\w*)|(?P<at>@[A-Za-z_]\w*)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|>=|<=|&&|\|\||[{}()\[\],:=|?<>.*])"
)
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    line: int
    first: bool  # first on its line


def tokenize(source: str) -> list[Token]:
    """All tokens, with an ``end`` token last."""
    out, at, line, first = [], 0, 1, True
    while at < len(source):
        m = _TOKEN.match(source, at)
        if m is None:
            raise WeftError("ParsingError", f"line {line}: unexpected {source[at]!r}")
        at = m.end()
        if m.lastgroup == "newline":
            line, first = line + 1, True
        elif m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m.group(), line, first))
            first = False
    return [*out, Token("end", "", line, True)]


def unquote(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPE.get(m[1], m[1]), text[1:-1], flags=re.S)

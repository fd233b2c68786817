"""Tokens of procedural SQL."""

from __future__ import annotations

import re
from typing import NamedTuple

_TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*)
  |(?P<string>N?'(?:[^']|'')*')
  |(?P<name>\[(?:[^\]]|\]\])*\]|"(?:[^"]|"")*"|«param:@[\w$#@]+»)
  |(?P<var>@@?[\w$#@]+)
  |(?P<word>[A-Za-z_\#À-￿][\w$\#@À-￿]*)
  |(?P<number>0x[0-9A-Fa-f]*|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)
  |(?P<op><>|!=|>=|<=|!<|!>|\*=|=\*|\+=|-=|/=|%=|<<|>>|::|[-+*/%&|^~=<>(),.;:?!{}$\\])""",
    re.VERBOSE | re.IGNORECASE,
)


class Token(NamedTuple):
    kind: str  # word, name, var, string, number, op
    text: str
    start: int
    end: int
    line: int

    @property
    def up(self) -> str:
        """A keyword's comparable form; quoted names are never keywords."""
        return self.text.upper() if self.kind in ("word", "op") else ""


class SqlError(ValueError):
    """The text can't be read; the message says where."""


def tokens(sql: str) -> list[Token]:
    out, at, line = [], 0, 1
    while at < len(sql):
        if sql.startswith("/*", at):
            depth, end = 1, at + 2
            while depth and end < len(sql):
                if sql.startswith("/*", end):
                    depth, end = depth + 1, end + 2
                elif sql.startswith("*/", end):
                    depth, end = depth - 1, end + 2
                else:
                    end += 1
            if depth:
                raise SqlError(f"line {line}: comment without an end")
        else:
            found = _TOKEN.match(sql, at)
            if not found:
                raise SqlError(f"line {line}: {sql[at]!r} is not understood")
            end = found.end()
            if found.lastgroup != "skip":
                out.append(Token(found.lastgroup, found.group(), at, end, line))
        line += sql.count("\n", at, end)
        at = end
    return out


def bare(name: str) -> str:
    """A name without brackets or quotes."""
    if name[:1] == "[":
        return name[1:-1].replace("]]", "]")
    return name[1:-1].replace('""', '"') if name[:1] == '"' else name


def unquote(text: str) -> str:
    """The value of a string literal."""
    return text[text.index("'") + 1 : -1].replace("''", "'")

"""Text functions of the graph, as columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_brackets(name: Column | str) -> Column:
    return F.regexp_replace(name, r"[\[\]\"]", "")


def normalise(name: Column | str) -> Column:
    """A name as a key: no brackets, lower case, without blanks at its ends."""
    return F.lower(F.trim(strip_brackets(name)))


def stable_hash(text: Column | str) -> Column:
    """First 8 digits of the SHA-1."""
    return F.substring(F.sha1(F.encode(text, "UTF-8")), 1, 8)


def slug(text: Column | str, most: int = 80) -> Column:
    """Letters, digits, "." and "-"; anything else becomes one "_"."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9.\-]+", "_"), r"^_+|_+$", ""), 1, most)


def one_line(text: Column | str, most: int = 300) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def with_schema(name: Column | str) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.when(name.contains("."), name).otherwise(F.concat(F.lit("dbo."), name))


def is_transient(name: Column | str) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return name.startswith("#") | name.startswith("@")


def escape_like(text: str, escape: str = "\\") -> str:
    return re.sub(r"([%_" + re.escape(escape) + "])", lambda m: escape + m.group(1), text)


_PHRASES = [
    (r"^NOT\s+EXISTS\s*\(\s*SELECT\b.*?\bFROM\s+([\w.\[\]]+).*$", r"\1 has no matching row"),
    (r"^EXISTS\s*\(\s*SELECT\b.*?\bFROM\s+([\w.\[\]]+).*$", r"\1 has a matching row"),
    (r"^@@ROWCOUNT\s*=\s*0$", "no row was touched"),
    (r"^@@ROWCOUNT\s*>\s*0$", "a row was touched"),
    (r"^@@TRANCOUNT\s*>\s*0$", "a transaction is open"),
    (r"^@@FETCH_STATUS\s*=\s*0$", "the cursor has a row"),
    (r"^([@\w.\[\]]+)\s+IS\s+NOT\s+NULL$", r"\1 is given"),
    (r"^([@\w.\[\]]+)\s+IS\s+NULL$", r"\1 is missing"),
    (r"^([@\w.\[\]]+)\s*=\s*(.+)$", r"\1 is \2"),
    (r"^([@\w.\[\]]+)\s*(?:<>|!=)\s*(.+)$", r"\1 is not \2"),
    (r"^([@\w.\[\]]+)\s*>=\s*(.+)$", r"\1 is at least \2"),
    (r"^([@\w.\[\]]+)\s*<=\s*(.+)$", r"\1 is at most \2"),
    (r"^([@\w.\[\]]+)\s*>\s*(.+)$", r"\1 is over \2"),
    (r"^([@\w.\[\]]+)\s*<\s*(.+)$", r"\1 is under \2"),
]


def naturalise(condition: str | None) -> str | None:
    """A condition in words; AND and OR at the top level join the parts."""
    if condition is None:
        return None
    text = condition.strip()
    while text.startswith("(") and text.endswith(")") and _closes(text):
        text = text[1:-1].strip()
    for word in ("OR", "AND"):
        parts = _split(text, word)
        if len(parts) > 1:
            return f" {word.lower()} ".join(naturalise(p) or "" for p in parts)
    for pattern, phrase in _PHRASES:
        if re.match(pattern, text, re.IGNORECASE | re.DOTALL):
            return re.sub(pattern, phrase, text, flags=re.IGNORECASE | re.DOTALL)
    if re.match(r"^NOT\s*\(", text, re.IGNORECASE):
        return f"not ({naturalise(re.sub(r'^NOT', '', text, flags=re.IGNORECASE))})"
    return text


def _closes(text: str) -> bool:
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if not depth:
            return i == len(text) - 1
    return False


def _split(text: str, word: str) -> list[str]:
    parts, depth, start, quoted, between = [], 0, 0, False, False
    for m in re.finditer(rf"'|\(|\)|\bBETWEEN\b|\b{word}\b", text, re.IGNORECASE):
        token = m.group().upper()
        if token == "'":
            quoted = not quoted
        elif not quoted:
            depth += (token == "(") - (token == ")")
            if token == "BETWEEN":
                between = True
            elif token == word and not depth:
                if word == "AND" and between:
                    between = False
                else:
                    parts.append(text[start : m.start()].strip())
                    start = m.end()
    return [*parts, text[start:].strip()]


def naturalised(condition: Column | str) -> Column:
    """`naturalise` over a column."""
    @F.pandas_udf("string")
    def run(conditions: pd.Series) -> pd.Series:
        return conditions.map(naturalise)

    return run(condition)

"""CHECK constraints in table definitions: found by their words, never by evaluating SQL."""

from __future__ import annotations

import re

_WORDS = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<text>'(?:[^']|'')*')|(?P<name>"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\]|[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<sign>.)""",
    re.S,
)


def words(sql: str) -> list[tuple[str, str]] | None:
    """(kind, word) without white space and comments; None if a quote or comment doesn't end."""
    out = []
    for m in _WORDS.finditer(sql):
        kind, word = m.lastgroup, m[0]
        if kind == "sign" and (word in "'\"`[" or sql.startswith("/*", m.start())):
            return None
        if kind == "name" and word[0] in "\"`[":
            end = {"[": "]"}.get(word[0], word[0])
            word = word[1:-1].replace(end * 2, end)
        if kind != "space":
            out.append((kind, word))
    return out


def checks(ddl: str) -> tuple[list[str], bool]:
    """Bodies of the CHECK clauses, and whether the text was clear."""
    spans, depth, start, expect = [], 0, None, False
    if words(ddl) is None:
        return [], False
    for m in _WORDS.finditer(ddl):
        kind, word = m.lastgroup, m[0]
        if kind == "space":
            continue
        if expect:
            if word != "(":
                return [], False
            expect, start, depth = False, m.end(), 1
            continue
        if start is None:
            expect = kind == "name" and word.upper() == "CHECK"
            continue
        depth += (word == "(") - (word == ")")
        if not depth:
            spans.append(ddl[start : m.start()].strip())
            start = None
    return (spans, True) if start is None and not expect else ([], False)


def mentions(check: str, column: str) -> bool:
    """Whether a CHECK names the column; an unclear one counts as naming it."""
    w = words(check)
    return w is None or any(k == "name" and x.lower() == column.lower() for k, x in w)


def normalized(check: str) -> str:
    """White space outside quotes as one blank."""
    if words(check) is None:
        return check
    out: list[str] = []
    for m in _WORDS.finditer(check):
        word = " " if m.lastgroup == "space" else m[0]
        if word != " " or out[-1:] != [" "]:
            out.append(word)
    return "".join(out).strip()

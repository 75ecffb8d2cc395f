"""Fragments of the oracle SQL that several queries share."""

from __future__ import annotations

from ..functions import vocab


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def texts(values: list[str]) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '([a-z0-9][a-z0-9_.\\-]*)', 1), lambda t: length(t) > 2 AND NOT list_contains({texts(vocab.STOPWORDS)}, t))"


def has_any(x: str, cues: list[str]) -> str:
    return f"len(list_filter({texts(cues)}, lambda c: contains({x}, c))) > 0"


def hits(x: str, cues: list[str]) -> str:
    return f"len(list_filter({texts(cues)}, lambda c: contains({x}, c)))"


def truncate(x: str, n: int) -> str:
    s = strip(x)
    return f"CASE WHEN length({s}) <= {n} THEN {s} ELSE regexp_replace(left({s}, {n - 1}), '\\s+$', '') || '…' END"


def collapse(x: str) -> str:
    return strip(f"regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def category(x: str, cues: dict[str, list[str]]) -> str:
    """The category with the most occurrences, the first of equals, else ''."""
    sums = ", ".join(f"{{'n': {' + '.join(f'((length(lower({x})) - length(replace(lower({x}), {text(w)}, {text('')}))) // {len(w)})' for w in words)}, 'p': {-i}, 'c': {text(name)}}}" for i, (name, words) in enumerate(cues.items()))
    best = f"list_max([{sums}])"
    return f"CASE WHEN ({best}).n > 0 THEN ({best}).c ELSE '' END"

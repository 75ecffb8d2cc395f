"""Cutting one page or answer of Markdown; the small helpers behind the ways to call them."""

from __future__ import annotations

import re
from collections.abc import Iterator

_TABLE = re.compile(r"(?:^[ \t]*\|.*\|[ \t]*$\n?){2,}", re.M)


def page_parts(markdown: str | None) -> Iterator[tuple[str, str]]:
    """(element type, content) of texts and tables in order. Runs of two or more lines between pipes are tables; images leave their alternative texts."""
    text, at = markdown or "", 0
    for m in [*_TABLE.finditer(text), None]:
        plain = re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"\1", text[at : m.start() if m else None]).strip()
        if plain:
            yield "TEXT", plain
        if m:
            yield "TABLE", m[0].strip()
            at = m.end()


_HEADED = re.compile(r"#{1,3}\s+(.*)")


def sections_of(markdown: str | None, wanted: list[str] | None) -> Iterator[tuple[str, str]]:
    """(title, section) of the sections whose headings hold one of the wanted titles, in order; without wanted titles none."""
    titles = [w.lower() for w in wanted or [] if w]
    for block in re.split(r"(?m)^(?=#{1,3}[ \t])", markdown or ""):
        headed = _HEADED.match(block)
        if headed and any(t in headed[1].lower() for t in titles):
            yield headed[1].rstrip(), block.rstrip()

"""Tolerant reading of what a language model wrote, for deployments that plug one in."""

from __future__ import annotations

import json
import re


def parse_object(text: str) -> dict:
    """The first JSON object in a text, fenced or not; {} if there is none."""
    bare = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text or "")
    for candidate in (bare, *(m[0] for m in re.finditer(r"\{.*\}", bare, re.S))):
        try:
            got = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(got, dict):
            return got
    return {}


def parse_list(text: str) -> list[str]:
    """A JSON list of strings, or else whatever stands in quotes."""
    m = re.search(r"\[.*\]", text or "", re.S)
    try:
        got = json.loads(m[0]) if m else None
    except ValueError:
        got = None
    return [str(x) for x in got] if isinstance(got, list) else re.findall(r'"([^"]+)"', text or "")

"""The fallback for languages without a parser: definitions and first calls by line."""

from __future__ import annotations

import re

from .base import Builder

_DEF = re.compile(r"\s*(?:fn|def|function|func) (\w+)")
_CALL = re.compile(r"(\w*)\(")
_KEYWORDS = frozenset("def fn for if match switch while".split())


def extract(path: str, language: str | None, text: str) -> Builder:
    out = Builder(path, language)
    current, name = None, None
    for number, line in enumerate(text.split("\n"), 1):
        made = _DEF.match(line)
        if made:
            name = made.group(1)
            current = f"fn:{path}:{name}"
            out._node(current, name, "function", number, number, {})
            out.edges.append({"source": out.file_id, "relation": "contains", "target_id": current})
            continue
        call = _CALL.search(line)
        callee = call.group(1) if call else ""
        if current and callee and not callee[0].isdigit() and callee not in _KEYWORDS and callee != name:
            out.ref(current, "calls", callee)
    seen, nodes = set(), []
    for node in out.nodes:
        if node["id"] not in seen:
            seen.add(node["id"])
            nodes.append(node)
    out.nodes = nodes
    return out

"""A tolerant tokenizer for brace languages, and matching brackets."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class Token(NamedTuple):
    text: str
    start: int
    end: int
    kind: str  # word, number, string, punct, life


_RUST = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)|(?P<string>b?r(?P<h>\#*)"(?:.|\n)*?"(?P=h)|b?"(?:[^"\\]|\\.)*"|b?'(?:[^'\\\n]|\\[^\n]{1,8}?)')"""
    r"""|(?P<life>'[A-Za-z_]\w*)|(?P<number>\d[\w.]*?(?=\.\.|\.[A-Za-z_]|[^\w.]|$))|(?P<word>(?:r\#)?[^\W\d]\w*)|(?P<punct>::|->|=>|\.\.=|\.\.|&&|\|\||.)""",
    re.S,
)
_SCRIPT = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)"""
    r"""|(?P<number>\d[\w.]*)|(?P<word>[#@]?[^\W\d][\w$]*|\$[\w$]*)|(?P<punct>=>|\?\.|\.\.\.|&&|\|\||.)""",
    re.S,
)


class Stream:
    def __init__(self, text: str, language: str):
        self.source = text
        pattern = _RUST if language == "rust" else _SCRIPT
        self.tokens = [Token(m[0], *m.span(), kind) for m in pattern.finditer(text) if (kind := m.lastgroup) != "skip"]
        self._texts, self._kinds = [t.text for t in self.tokens], [t.kind for t in self.tokens]
        self._lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.match = self._matched()

    def _matched(self) -> dict[int, int]:
        """The place of each opening bracket's closing one; an unclosed one is closed at the end."""
        stack, out, texts = [], {}, self._texts
        for k, (t, kind) in enumerate(zip(texts, self._kinds)):
            if kind != "punct":
                continue
            if t in OPEN:
                stack.append(k)
            elif t in CLOSE and stack and OPEN[texts[stack[-1]]] == t:
                out[stack.pop()] = k
        for k in stack:
            out[k] = len(self.tokens)
        return out

    def text(self, k: int) -> str:
        return self._texts[k] if 0 <= k < len(self._texts) else ""

    def kind(self, k: int) -> str:
        return self._kinds[k] if 0 <= k < len(self._kinds) else ""

    def line(self, k: int) -> int:
        k = min(k, len(self.tokens) - 1)
        return bisect_right(self._lines, self.tokens[k].start) if self.tokens else 1

    def between(self, a: int, b: int) -> str:
        return self.source[self.tokens[a].start : self.tokens[b - 1].end] if a < b <= len(self.tokens) else ""

    def close(self, k: int) -> int:
        return self.match.get(k, len(self.tokens))

    def angle_end(self, k: int, end: int) -> int:
        """The place after the > that closes the < at k, or k if there is none before a body or statement ends."""
        depth, at = 0, k
        while at < end:
            t = self.text(at)
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if depth == 0:
                    return at + 1
            elif t in ("(", "[", "{"):
                at = self.close(at)
            elif t == ";":
                break
            at += 1
        return k

    def split(self, a: int, b: int, mark: str = ",") -> list[tuple[int, int]]:
        """The stretches between marks that stand in no brackets."""
        out, start, at, depth = [], a, a, 0
        while at < b:
            t = self.text(at)
            if self.kind(at) == "punct":
                if t in OPEN:
                    at = min(self.close(at), b)
                elif t == "<":
                    depth += 1
                elif t == ">" and depth:
                    depth -= 1
                elif t == mark and not depth:
                    out.append((start, at))
                    start = at + 1
            at += 1
        if start < b:
            out.append((start, b))
        return out

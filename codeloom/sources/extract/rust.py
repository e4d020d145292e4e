"""Rust sources by a tolerant item parser over tokens."""

from __future__ import annotations

from .base import Builder
from .tokens import Stream

_NOT_TYPES = frozenset("as async const crate dyn extern fn for impl in mut ref self static super unsafe where Self".split())
_KEYWORDS = frozenset("as async await break const continue else extern fn for if impl in let loop match mod move mut pub ref return static struct trait type unsafe use where while".split())
_MAKERS = frozenset("default from new with_capacity".split())
_LOCAL_HEADS = ("crate", "self", "super", "Self")


class _Rust:
    def __init__(self, path: str, language: str | None, text: str):
        self.out = Builder(path, language)
        self.s = Stream(text, "rust")
        self.types: dict[str, str] = {}
        self.owned: list[tuple[str, str]] = []
        self.implements: list[tuple[str, str]] = []

    # --- types

    def paths(self, a: int, b: int) -> list[str]:
        """Every type path named between a and b; paths into this crate keep only their last segment."""
        out, k = [], a
        while k < b:
            if self.s.kind(k) == "word" and self.s.text(k - 1) != "::":
                parts = [self.s.text(k)]
                while self.s.text(k + 1) == "::" and self.s.kind(k + 2) == "word" and k + 2 < b:
                    parts.append(self.s.text(k + 2))
                    k += 2
                if len(parts) > 1 and parts[0] in _LOCAL_HEADS:
                    parts = parts[-1:]
                if parts[0] not in _NOT_TYPES and not (self.s.text(k + 1) == "=" and k + 1 < b):
                    out.append("::".join(parts))
            k += 1
        return out

    def base(self, a: int, b: int) -> str:
        found = self.paths(a, b)
        return found[0] if found else "Self" if any(self.s.text(k) == "Self" for k in range(a, b)) else ""

    def parameters(self, a: int, b: int, source: str | None, where: tuple[int, int] | None = None) -> set[str]:
        """Names of the type parameters between a and b; their bounds, and those of the where clause, as references of source."""
        names = set()
        for lo, hi in self.s.split(a, b):
            if self.s.kind(lo) == "life":
                continue
            if self.s.text(lo) == "const":
                names.add(self.s.text(lo + 1))
                continue
            names.add(self.s.text(lo))
        self.out.type_parameters.append(names)
        if source:
            clauses = self.s.split(a, b) + (self.s.split(*where) if where else [])
            for lo, hi in clauses:
                colon = next((k for k in range(lo, hi) if self.s.text(k) == ":"), None)
                if colon is None or self.s.kind(lo) == "life" or self.s.text(lo) == "const":
                    continue
                for x, y in self.s.split(colon + 1, hi, "+"):
                    if self.s.text(x) != "?":
                        for name in self.paths(x, y):
                            self.out.type_ref(source, "bound", name)
        return names

    # --- items

    def items(self, k: int, end: int, owner: str | None = None, owner_id: str | None = None, trait: bool = False) -> None:
        while k < end:
            begin = k
            while self.s.text(k) == "#" and k < end:
                k += 1 + (self.s.text(k + 1) == "!")
                k = self.s.close(k) + 1
            public = False
            if self.s.text(k) == "pub":
                public, k = True, k + 1
                if self.s.text(k) == "(":
                    k = self.s.close(k) + 1
            while self.s.text(k) in ("unsafe", "async", "default") or self.s.text(k) == "const" and self.s.text(k + 1) in ("fn", "unsafe", "async"):
                k += 1
            if self.s.text(k) == "extern" and self.s.kind(k + 1) == "string":
                k += 2
                if self.s.text(k) == "{":
                    k = self.s.close(k) + 1
                    continue
            word = self.s.text(k)
            if word == "fn" and self.s.kind(k + 1) == "word":
                k = self.function(k, end, owner, owner_id, public, trait)
            elif word in ("struct", "union", "enum", "trait") and self.s.kind(k + 1) == "word":
                k = self.type_item(k, end, word, public)
            elif word == "impl":
                k = self.impl(k, end)
            elif word == "mod" and self.s.text(k + 2) == "{":
                self.items(k + 3, self.s.close(k + 2))
                k = self.s.close(k + 2) + 1
            elif word == "use":
                k = self.use(k, end, public)
            elif word == "macro_rules":
                k = self.after(k, end)
            elif word == "type" and trait:
                stop = self.after(k, end)
                colon = next((x for x in range(k, stop) if self.s.text(x) == ":"), None)
                if colon and owner_id:
                    for name in self.paths(colon + 1, stop):
                        self.out.type_ref(owner_id, "bound", name)
                k = stop
            elif word in ("type", "const", "static", "extern", "mod"):
                k = self.after(k, end)
            else:
                k += 1
            k = max(k, begin + 1)

    def after(self, k: int, end: int) -> int:
        """The place after the item at k: past its ; or its braces."""
        while k < end:
            if self.s.text(k) == ";":
                return k + 1
            if self.s.text(k) == "{":
                stop = self.s.close(k) + 1
                return stop + (self.s.text(stop) == ";")
            if self.s.text(k) in ("(", "["):
                k = self.s.close(k)
            k += 1
        return end

    def generics(self, k: int, end: int) -> tuple[int, int, int]:
        """(first, last, place after) of the parameters if < stands at k."""
        if self.s.text(k) != "<":
            return k, k, k
        stop = self.s.angle_end(k, end)
        return (k + 1, stop - 1, stop) if stop > k else (k, k, k)

    def where_of(self, k: int, end: int) -> tuple[int, int] | None:
        if self.s.text(k) != "where":
            return None
        stop = k
        while stop < end and self.s.text(stop) not in ("{", ";"):
            stop += 1
        return k + 1, stop

    def type_item(self, k: int, end: int, word: str, public: bool) -> int:
        name, kind = self.s.text(k + 1), {"union": "struct"}.get(word, word)
        a, b, at = self.generics(k + 2, end)
        body = at
        while body < end and self.s.text(body) not in ("{", ";"):
            body = self.s.close(body) + 1 if self.s.text(body) == "(" else body + 1
        stop = self.s.close(body) + 1 if self.s.text(body) == "{" else body + 1
        id_ = self.out.add_def(kind, name, self.s.line(k), self.s.line(stop - 1), self.s.between(k, body), abstract="true" if kind == "trait" else None)
        self.types.setdefault(name, id_)
        if public:
            self.out.export("local", name)
        where = next((w for x in range(at, body) if (w := self.where_of(x, end))), None)
        self.parameters(a, b, id_, where)
        if word == "trait":
            if self.s.text(at) == ":":
                last = where[0] - 1 if where else body
                for x, y in self.s.split(at + 1, last, "+"):
                    if self.s.text(x) != "?":
                        for sup in self.paths(x, y)[:1]:
                            self.out.ref(id_, "extends", sup)
            self.items(body + 1, stop - 1, name, id_, trait=True)
        elif word == "enum":
            for x, y in self.s.split(body + 1, stop - 1):
                while self.s.text(x) == "#":
                    x = self.s.close(x + 1) + 1
                if self.s.kind(x) != "word":
                    continue
                variant = self.out.add_def("enum_variant", self.s.text(x), self.s.line(x), self.s.line(y - 1), self.s.between(x, y), owner=name, container=id_)
                if self.s.text(x + 1) in ("(", "{"):
                    self.fields(variant, x + 1)
        elif self.s.text(body) == "{":
            self.fields(id_, body)
        elif self.s.text(at) == "(":
            self.fields(id_, at)
        self.out.type_parameters.pop()
        return stop

    def fields(self, source: str, k: int) -> None:
        for n, (x, y) in enumerate(self.s.split(k + 1, self.s.close(k))):
            while self.s.text(x) == "#":
                x = self.s.close(x + 1) + 1
            vis = "private"
            if self.s.text(x) == "pub":
                vis, x = "pub", x + 1
                if self.s.text(x) == "(":
                    x = self.s.close(x) + 1
            named = self.s.text(k) == "{"
            field = self.s.text(x) if named else str(n)
            for name in self.paths(x + 2 if named else x, y):
                self.out.type_ref(source, "field", name, field=field, vis=vis)

    def impl(self, k: int, end: int) -> int:
        a, b, at = self.generics(k + 1, end)
        body, split = at, None
        while body < end and self.s.text(body) not in ("{", ";"):
            if self.s.text(body) == "for" and self.s.text(body + 1) != "<":
                split = body
            if self.s.text(body) == "where":
                break
            body += 1
        head = body
        while body < end and self.s.text(body) not in ("{", ";"):
            body += 1
        stop = self.s.close(body) + 1 if self.s.text(body) == "{" else body + 1
        owner = self.base(split + 1 if split else at, head).rsplit("::", 1)[-1]
        if split and owner:
            trait = self.base(at, split)
            if trait:
                self.implements.append((owner, trait))
        self.parameters(a, b, None)
        if self.s.text(body) == "{":
            self.items(body + 1, stop - 1, owner or None)
        self.out.type_parameters.pop()
        return stop

    def use(self, k: int, end: int, public: bool) -> int:
        stop = k
        while stop < end and self.s.text(stop) != ";":
            stop += 1

        def tree(a: int, b: int, prefix: list[str]) -> None:
            parts, at = list(prefix), a
            while at < b:
                t = self.s.text(at)
                if t == "{":
                    for x, y in self.s.split(at + 1, self.s.close(at)):
                        tree(x, y, parts)
                    return
                if t == "*":
                    if public:
                        self.out.export("star", specifier="::".join(parts))
                    return
                if t == "as":
                    self.leaf(parts, self.s.text(at + 1), public)
                    return
                if t != "::":
                    parts.append(t)
                at += 1
            self.leaf(parts, None, public)

        tree(k + 1, stop, [])
        return stop + 1

    def leaf(self, parts: list[str], alias: str | None, public: bool) -> None:
        if not parts or alias == "_":
            return
        if parts[-1] == "self" and len(parts) > 1:
            parts = parts[:-1]
        *head, last = parts
        bound, specifier = alias or last, "::".join(head) or None
        self.out.ref(self.out.file_id, "imports", bound, specifier=specifier, imported=last if specifier and bound != last else None)
        if public:
            if specifier:
                self.out.export("reexport", bound, specifier, last)
            else:
                self.out.export("local", bound)

    def function(self, k: int, end: int, owner: str | None, owner_id: str | None, public: bool, trait: bool) -> int:
        name = self.s.text(k + 1)
        a, b, at = self.generics(k + 2, end)
        close = self.s.close(at)
        body = close + 1
        while body < end and self.s.text(body) not in ("{", ";"):
            body += 1
        bodied = self.s.text(body) == "{"
        stop = self.s.close(body) + 1 if bodied else body + 1
        if not bodied and not trait:
            return stop
        where = next((w for x in range(close, body) if (w := self.where_of(x, end))), None)
        returned = (close + 2, where[0] - 1 if where else body) if self.s.text(close + 1) == "->" else None
        result = (self.base(*returned) if returned else "") or None
        result = owner if result == "Self" else result
        id_ = self.out.add_def("function", name, self.s.line(k), self.s.line(stop - 1), self.s.between(k, body), owner=owner, container=owner_id, returns=result, abstract="true" if not bodied else None)
        if owner:
            self.owned.append((id_, owner))
        elif public:
            self.out.export("local", name)
        self.parameters(a, b, id_, where)
        scope: dict[str, tuple] = {"self": ("type", owner)} if owner else {}
        for x, y in self.s.split(at + 1, close):
            colon = next((c for c in range(x, y) if self.s.text(c) == ":"), None)
            if colon is None:
                continue
            for found in self.paths(colon + 1, y):
                self.out.type_ref(id_, "param", found, skip=name)
            known = self.base(colon + 1, y)
            if self.s.kind(colon - 1) == "word" and known:
                scope[self.s.text(colon - 1)] = ("type", owner if known == "Self" else known)
        if returned:
            for found in self.paths(*returned):
                self.out.type_ref(id_, "return", found, skip=name)
        if bodied:
            self.body(body + 1, stop - 1, id_, owner, [scope])
        self.out.type_parameters.pop()
        return stop

    # --- bodies

    def body(self, k: int, end: int, source: str, owner: str | None, scopes: list[dict]) -> None:
        s = self.s
        while k < end:
            t = s.text(k)
            if t == "{":
                scopes.append({})
            elif t == "}":
                if len(scopes) > 1:
                    scopes.pop()
            elif t == "#" and s.text(k + 1) == "[":
                k = s.close(k + 1)
            elif t == "fn" and s.kind(k + 1) == "word":
                k = self.function(k, end, None, None, False, False) - 1
            elif t in ("struct", "enum", "trait") and s.kind(k + 1) == "word":
                k = self.type_item(k, end, t, False) - 1
            elif t == "impl" and s.text(k - 1) in (";", "{", "}"):
                k = self.impl(k, end) - 1
            elif t == "use" and s.text(k - 1) in (";", "{", "}"):
                k = self.use(k, end, False) - 1
            elif t == "let":
                self.let(k, end, owner, scopes)
            elif s.kind(k) == "word" and s.text(k + 1) == "!" and s.text(k + 2) in ("(", "[", "{"):
                k = s.close(k + 2)
            elif s.kind(k) == "word" and t not in _KEYWORDS:
                self.call(k, end, source, owner, scopes)
            k += 1

    def let(self, k: int, end: int, owner: str | None, scopes: list[dict]) -> None:
        s = self.s
        at = k + 1 + (s.text(k + 1) == "mut")
        name = s.text(at)
        if s.kind(at) != "word":
            return
        if s.text(at + 1) == ":":
            stop = at + 2
            while stop < end and s.text(stop) not in ("=", ";"):
                stop += 1
            known = self.base(at + 2, stop)
            if known:
                scopes[-1][name] = ("type", owner if known == "Self" else known)
            return
        if s.text(at + 1) != "=":
            return
        x = at + 2
        while s.text(x) in ("&", "mut"):
            x += 1
        parts = [s.text(x)]
        while s.text(x + 1) == "::" and s.kind(x + 2) == "word":
            parts.append(s.text(x + 2))
            x += 2
        parts = [owner if p == "Self" and owner else p for p in parts]
        last = parts[-1]
        if s.text(x + 1) == "{" and last[:1].isupper():
            scopes[-1][name] = ("type", last)
        elif s.text(x + 1) == "(":
            closed = s.close(x + 1)
            if s.text(closed + 1) in (".",):
                scopes[-1].pop(name, None)
                scopes[-1][name] = ("opaque",)
            elif len(parts) > 1 and parts[-2][:1].isupper():
                scopes[-1][name] = ("type", parts[-2]) if last in _MAKERS else ("call", last, parts[-2])
            elif s.kind(x) == "word":
                scopes[-1][name] = ("call", last, None)
        else:
            scopes[-1][name] = ("opaque",)

    def call(self, k: int, end: int, source: str, owner: str | None, scopes: list[dict]) -> None:
        s, name, at = self.s, self.s.text(k), k + 1
        if s.text(at) == "::" and s.text(at + 1) == "<":
            at = s.angle_end(at + 1, end)
        if s.text(at) != "(":
            return
        before = s.text(k - 1)
        if before == ".":
            hints: dict[str, str] = {"recv": "opaque"}
            if s.kind(k - 2) == "word" and s.text(k - 3) not in (".", "::"):
                known = next((f[s.text(k - 2)] for f in reversed(scopes) if s.text(k - 2) in f), None)
                if known and known[0] == "type" and known[1]:
                    hints = {"type": known[1]}
                elif known and known[0] == "call":
                    hints = {"recv_returns": known[1], "recv_returns_owner": known[2]}
            self.out.ref(source, "calls", name, **hints)
        elif before == "::":
            qualifier = s.text(k - 2)
            if qualifier == ">":
                self.out.ref(source, "calls", name)
                return
            if qualifier == "Self":
                qualifier = owner or ""
            self.out.ref(source, "calls", name, type=qualifier if qualifier[:1].isupper() else None)
        elif name not in ("Some", "Ok", "Err", "None"):
            self.out.ref(source, "calls", name)


def extract(path: str, language: str | None, text: str) -> Builder:
    rust = _Rust(path, language, text)
    rust.items(0, len(rust.s.tokens))
    for id_, owner in rust.owned:
        if owner in rust.types:
            rust.out.reparent(id_, rust.types[owner])
    for owner, trait in rust.implements:
        if owner in rust.types:
            rust.out.ref(rust.types[owner], "implements", trait)
    return rust.out.finish()

"""TypeScript and JavaScript sources by a tolerant parser over tokens."""

from __future__ import annotations

from .base import Builder
from .tokens import Stream

_MODIFIERS = frozenset("abstract accessor async declare export override private protected public readonly static default get set".split())
_NOT_CALLS = frozenset("as await catch constructor do else for function if import in instanceof new of return super switch typeof void while with yield".split())
_NOT_TYPES = frozenset("as asserts extends infer in is keyof new out readonly typeof unique this".split())


class _Script:
    def __init__(self, path: str, language: str | None, text: str):
        self.out = Builder(path, language)
        self.s = Stream(text, "typescript")

    # --- types

    def names(self, a: int, b: int) -> list[str]:
        """Every type named between a and b; of a dotted path the last segment."""
        out, k, s = [], a, self.s
        while k < b:
            if s.kind(k) == "word" and s.text(k) not in _NOT_TYPES:
                while s.text(k + 1) == "." and s.kind(k + 2) == "word" and k + 2 < b:
                    k += 2
                if s.text(k + 1) not in (":", "?") or s.text(k + 1) == "?" and s.text(k + 2) != ":":
                    out.append(s.text(k))
            elif s.text(k) == "{":
                inner_end = min(s.close(k), b)
                for x, y in s.split(k + 1, inner_end, ";"):
                    colon = next((c for c in range(x, y) if s.text(c) == ":"), None)
                    if colon is not None:
                        out += self.names(colon + 1, y)
                k = inner_end
            k += 1
        return out

    def type_end(self, k: int, end: int, stops: tuple[str, ...]) -> int:
        """Where the type that begins at k ends."""
        depth, s = 0, self.s
        while k < end:
            t = s.text(k)
            if depth == 0 and t in stops:
                return k
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
            elif t in ("(", "[", "{"):
                k = s.close(k)
            k += 1
        return end

    def parameters(self, k: int, end: int, source: str) -> int:
        """Type parameters if < stands at k, their bounds as references; the place after them."""
        names, s = set(), self.s
        stop = k
        if s.text(k) == "<":
            stop = s.angle_end(k, end)
            for x, y in s.split(k + 1, stop - 1):
                names.add(s.text(x))
                if s.text(x + 1) == "extends":
                    last = next((c for c in range(x, y) if s.text(c) == "="), y)
                    for name in self.names(x + 2, last):
                        self.out.type_ref(source, "bound", name)
        self.out.type_parameters.append(names)
        return stop

    # --- statements

    def statements(self, k: int, end: int, source: str | None = None, owner: str | None = None, scopes: list[dict] | None = None, top: bool = False) -> None:
        while k < end:
            k = max(k + 1, self.statement(k, end, source, owner, scopes or [{}], top))

    def statement(self, k: int, end: int, source: str | None, owner: str | None, scopes: list[dict], top: bool) -> int:
        s, exported = self.s, False
        begin = k
        while s.text(k).startswith("@"):
            k = s.close(k + 1) + 1 if s.text(k + 1) == "(" else k + 1
        if s.text(k) == "export" and top:
            done = self.export_from(k, end)
            if done:
                return done
            exported, k = True, k + 1
            if s.text(k) == "default":
                k += 1
        if s.text(k) == "import" and top and s.text(k + 1) not in ("(", "."):
            return self.imports(k, end)
        abstract = False
        while s.text(k) in ("declare", "abstract", "async") and s.kind(k + 1) == "word":
            abstract |= s.text(k) == "abstract"
            k += 1
        word, name = s.text(k), s.text(k + 1)
        if word == "class" and s.kind(k + 1) == "word":
            return self.class_like(k, end, "class", exported, abstract)
        if word == "interface" and s.kind(k + 1) == "word":
            return self.class_like(k, end, "interface", exported, True)
        if word == "enum" or word == "const" and name == "enum":
            return self.enum(k + (word == "const"), end, exported)
        if word == "type" and s.kind(k + 1) == "word" and s.text(k + 2) in ("=", "<"):
            return self.alias(k, end, exported)
        if word == "function":
            star = s.text(k + 1) == "*"
            if s.kind(k + 1 + star) == "word":
                return self.function(k + 1 + star, end, None, None, exported)
        if word in ("namespace", "module") and s.kind(k + 1) in ("word", "string"):
            brace = k + 2
            while brace < end and s.text(brace) not in ("{", ";"):
                brace += 1
            if s.text(brace) == "{":
                self.statements(brace + 1, s.close(brace), top=top)
                return s.close(brace) + 1
        if word in ("const", "let", "var") and s.kind(k + 1) == "word":
            done = self.variable(k, end, source, owner, scopes, exported)
            if done:
                return done
        if source is not None:
            self.expression(k, source, owner, scopes)
        elif s.text(k) == "{":
            return s.close(k) + 1 if not top else k + 1
        return max(k, begin) + 1

    def export_from(self, k: int, end: int) -> int:
        s = self.s
        if s.text(k + 1) == "*":
            if s.text(k + 2) == "as":
                return k + 6
            if s.text(k + 2) == "from":
                self.out.export("star", specifier=s.text(k + 3)[1:-1])
                return k + 4
        at = k + 1 + (s.text(k + 1) == "type")
        if s.text(at) != "{":
            return 0
        close = s.close(at)
        specifier = s.text(close + 2)[1:-1] if s.text(close + 1) == "from" else None
        for x, y in s.split(at + 1, close):
            x += s.text(x) == "type" and y - x > 1
            name, bound = s.text(x), s.text(x + 2) if s.text(x + 1) == "as" else s.text(x)
            if specifier:
                self.out.export("reexport", bound, specifier, name)
            elif bound == name:
                self.out.export("local", name)
        return close + (3 if specifier else 1)

    def imports(self, k: int, end: int) -> int:
        s, out = self.s, self.out
        stop = k + 1
        while stop < end and s.kind(stop) != "string" and s.text(stop) != ";":
            stop += 1
        specifier = s.text(stop)[1:-1] if s.kind(stop) == "string" else None
        at = k + 1 + (s.text(k + 1) == "type" and s.text(k + 2) != "from")
        if not specifier:
            return stop + 1
        if s.kind(at) == "word" and s.text(at) != "from":
            out.ref(out.file_id, "imports", s.text(at), specifier=specifier)
            at += 1 + (s.text(at + 1) == ",")
        if s.text(at) == "*":
            out.ref(out.file_id, "imports", s.text(at + 2), specifier=specifier)
        elif s.text(at) == "{":
            for x, y in s.split(at + 1, s.close(at)):
                x += s.text(x) == "type" and y - x > 1 and s.text(x + 1) != "as"
                alias = s.text(x + 2) if s.text(x + 1) == "as" else None
                out.ref(out.file_id, "imports", alias or s.text(x), specifier=specifier, imported=s.text(x) if alias else None)
        return stop + 1

    def class_like(self, k: int, end: int, kind: str, exported: bool, abstract: bool) -> int:
        s, name = self.s, self.s.text(k + 1)
        body = k + 2
        while body < end and s.text(body) != "{":
            body = s.angle_end(body, end) if s.text(body) == "<" and s.angle_end(body, end) > body else body + 1
        stop = s.close(body)
        id_ = self.out.add_def(kind, name, s.line(k), s.line(stop), s.between(k, body), abstract="true" if abstract else None)
        if exported:
            self.out.export("local", name)
        at = self.parameters(k + 2, body, id_)
        relation = None
        for x in range(at, body):
            if s.text(x) in ("extends", "implements"):
                relation = s.text(x)
            elif relation and s.kind(x) == "word" and s.text(x - 1) in ("extends", "implements", ","):
                last = x
                while s.text(last + 1) == ".":
                    last += 2
                self.out.ref(id_, relation, s.text(last))
        self.members(body + 1, stop, id_, name, kind == "interface")
        self.out.type_parameters.pop()
        return stop + 1

    def members(self, k: int, end: int, id_: str, owner: str, interface: bool) -> None:
        s = self.s
        while k < end:
            begin, abstract = k, interface
            while s.text(k).startswith("@"):
                k = s.close(k + 1) + 1 if s.text(k + 1) == "(" else k + 1
            vis = "public"
            while s.text(k) in _MODIFIERS and (s.kind(k + 1) in ("word", "string") or s.text(k + 1) in ("*", "[")):
                abstract |= s.text(k) == "abstract"
                vis = s.text(k) if s.text(k) in ("private", "protected") else vis
                k += 1
            k += s.text(k) == "*"
            if s.kind(k) == "word":
                after = k + 1 + (s.text(k + 1) in ("?", "!"))
                if s.text(after) in ("(", "<"):
                    k = self.method(k, after, end, id_, owner, abstract)
                    continue
                if s.text(after) == ":":
                    stop = self.type_end(after + 1, end, (";", "=", ",", "}"))
                    stop = min(stop, self.line_end(after + 1, stop))
                    for name in self.names(after + 1, stop):
                        self.out.type_ref(id_, "field", name, field=s.text(k), vis=vis)
                    k = stop
                    if s.text(k) != "=":
                        k += s.text(k) in (";", ",")
                        continue
                if s.text(k) == "=" or s.text(after) == "=":
                    at = (k if s.text(k) == "=" else after) + 1
                    arrow = self.arrow_at(at, end)
                    if arrow:
                        k = self.arrow(s.text(begin if s.kind(begin) == "word" else at - 2), at, arrow, end, owner, id_)
                        continue
                    while k < end and s.text(k) != ";" and not (s.line(k + 1) > s.line(k) and s.text(k) not in ("=", ",", "(")):
                        k = s.close(k) if s.text(k) in ("(", "[", "{") else k + 1
            elif s.text(k) in ("(", "[", "{"):
                k = s.close(k)
            k = max(k + 1, begin + 1)

    def line_end(self, k: int, end: int) -> int:
        """The first token on a later line than a complete type's."""
        s, at = self.s, k
        while at < end:
            t = s.text(at)
            if t in ("(", "[", "{"):
                at = s.close(at)
            if at + 1 < end and s.line(at + 1) > s.line(at) and s.text(at) not in ("|", "&", "=>", "<", ",", ":") and s.text(at + 1) not in ("|", "&", "=>", ">", "."):
                return at + 1
            at += 1
        return end

    def method(self, k: int, at: int, end: int, id_: str | None, owner: str | None, abstract: bool) -> int:
        s = self.s
        paren = s.angle_end(at, end) if s.text(at) == "<" else at
        close = s.close(paren)
        body, result = close + 1, None
        if s.text(body) == ":":
            body = self.type_end(close + 2, end, (";", "{", ",", "}")) if s.text(close + 2) != "{" else s.close(close + 2) + 1
            if s.text(body) != "{":
                body = min(body, self.line_end(close + 2, body))
            result = (close + 2, body)
        bodied = s.text(body) == "{"
        if not bodied and not abstract:
            return max(body, close + 1)
        self.define(k, at, paren, result, body, bodied, owner, id_, abstract and not bodied)
        return s.close(body) + 1 if bodied else body + 1

    def define(self, k: int, at: int, paren: int, result: tuple[int, int] | None, body: int, bodied: bool, owner: str | None, container: str | None, abstract: bool, name: str | None = None, expression: int | None = None) -> str:
        s, name = self.s, name or self.s.text(k)
        returned = self.names(*result) if result else []
        last = s.close(body) if bodied else (expression or body)
        id_ = self.out.add_def("function", name, s.line(k), s.line(last), s.between(k, body if bodied else max(paren + 1, s.close(paren) + 1)), owner=owner, container=container, returns=returned[0] if returned else None, abstract="true" if abstract else None)
        self.parameters(at, paren, id_)
        scope: dict[str, str] = {"this": owner} if owner else {}
        for x, y in s.split(paren + 1, s.close(paren)):
            while s.text(x) in _MODIFIERS or s.text(x) in ("...",) or s.text(x).startswith("@"):
                x += 1
            colon = x + 1 + (s.text(x + 1) == "?")
            if s.text(colon) == ":" and s.kind(x) == "word":
                stop = self.type_end(colon + 1, y, ("=",))
                found = self.names(colon + 1, stop)
                for t in found:
                    self.out.type_ref(id_, "param", t, skip=name)
                if found:
                    scope[s.text(x)] = found[0]
        for t in returned:
            self.out.type_ref(id_, "return", t, skip=name)
        if bodied:
            self.statements(body + 1, s.close(body), id_, owner, [scope])
        elif expression:
            for x in range(body, expression):
                self.expression(x, id_, owner, [scope])
        self.out.type_parameters.pop()
        return id_

    def function(self, k: int, end: int, owner: str | None, id_: str | None, exported: bool) -> int:
        at = k + 1
        before = len(self.out.nodes)
        stop = self.method(k, at, end, id_, owner, False)
        if exported and len(self.out.nodes) > before:
            self.out.export("local", self.s.text(k))
        return stop

    def enum(self, k: int, end: int, exported: bool) -> int:
        s, name, body = self.s, self.s.text(k + 1), k + 2
        if s.text(body) != "{":
            return k + 1
        id_ = self.out.add_def("enum", name, s.line(k), s.line(s.close(body)), s.between(k, body))
        if exported:
            self.out.export("local", name)
        for x, y in s.split(body + 1, s.close(body)):
            label = s.text(x)[1:-1] if s.kind(x) == "string" else s.text(x)
            self.out.add_def("enum_variant", label, s.line(x), s.line(y - 1), s.between(x, y), owner=name, container=id_)
        return s.close(body) + 1

    def alias(self, k: int, end: int, exported: bool) -> int:
        s, name = self.s, self.s.text(k + 1)
        equals = k + 2
        while equals < end and s.text(equals) != "=":
            equals = s.angle_end(equals, end) if s.text(equals) == "<" else equals + 1
        stop = self.type_end(equals + 1, end, (";",))
        stop = min(stop, self.line_end(equals + 1, stop))
        id_ = self.out.add_def("type_alias", name, s.line(k), s.line(max(k, stop - 1)), s.between(k, equals))
        if exported:
            self.out.export("local", name)
        self.parameters(k + 2, equals, id_)
        if s.text(equals + 1) == "{":
            for x, y in s.split(equals + 2, s.close(equals + 1), ";"):
                for a, b in s.split(x, y):
                    colon = next((c for c in range(a, b) if s.text(c) == ":"), None)
                    if colon is not None and s.text(a + 1) in (":", "?"):
                        for t in self.names(colon + 1, b):
                            self.out.type_ref(id_, "field", t, field=s.text(a))
        self.out.type_parameters.pop()
        return stop

    def arrow_at(self, k: int, end: int) -> int:
        """The place of => (or of the word function) if a function expression begins at k."""
        s = self.s
        k += s.text(k) == "async"
        if s.text(k) == "function":
            return k
        at = s.angle_end(k, end) if s.text(k) == "<" else k
        if s.text(at) == "(":
            close = s.close(at)
            if s.text(close + 1) == "=>":
                return close + 1
            if s.text(close + 1) == ":":
                stop = self.type_end(close + 2, min(end, close + 64), ("=>", ";", "="))
                return stop if s.text(stop) == "=>" else 0
        elif s.kind(at) == "word" and s.text(at + 1) == "=>":
            return at + 1
        return 0

    def arrow(self, name: str, k: int, arrow: int, end: int, owner: str | None, id_: str | None) -> int:
        s = self.s
        k += s.text(k) == "async"
        if s.text(arrow) == "function":
            paren = arrow + 1
            while s.text(paren) != "(" and paren < end:
                paren += 1
            close = s.close(paren)
            body = close + 1
            result = None
            if s.text(body) == ":":
                body = self.type_end(close + 2, end, ("{", ";"))
                result = (close + 2, body)
            self.define(k, paren, paren, result, body, s.text(body) == "{", owner, id_, False, name)
            return s.close(body) + 1 if s.text(body) == "{" else body
        at = k
        paren = s.angle_end(k, end) if s.text(k) == "<" else k
        close = s.close(paren) if s.text(paren) == "(" else paren
        result = (close + 2, arrow) if s.text(close + 1) == ":" else None
        body = arrow + 1
        if s.text(paren) != "(":
            paren = body if s.text(body) == "(" else paren
        if s.text(body) == "{":
            self.define(k, at, paren, result, body, True, owner, id_, False, name)
            return s.close(body) + 1
        stop = body
        while stop < end and s.text(stop) != ";" and not (stop > body and s.line(stop) > s.line(stop - 1) and s.text(stop) not in (".", "?.", "?", ":", "&&", "||", "+")):
            stop = s.close(stop) + 1 if s.text(stop) in ("(", "[", "{") else stop + 1
        self.define(k, at, paren, result, body, False, owner, id_, False, name, expression=min(stop, end))
        return stop

    def variable(self, k: int, end: int, source: str | None, owner: str | None, scopes: list[dict], exported: bool) -> int:
        s, name, at = self.s, self.s.text(k + 1), k + 2
        if s.text(at) == ":":
            stop = self.type_end(at + 1, end, ("=", ";"))
            known = self.names(at + 1, stop)
            if known:
                scopes[-1][name] = known[0]
            at = stop
        if s.text(at) != "=":
            return 0
        arrow = self.arrow_at(at + 1, end)
        if arrow:
            stop = self.arrow(name, at + 1, arrow, end, None, None)
            if exported:
                self.out.export("local", name)
            return stop
        if s.text(at + 1) == "new" and s.kind(at + 2) == "word":
            scopes[-1][name] = s.text(at + 2)
        return 0

    def expression(self, k: int, source: str, owner: str | None, scopes: list[dict]) -> None:
        s, name = self.s, self.s.text(k)
        if s.kind(k) != "word" or name in _NOT_CALLS or name[0] in "#@":
            return
        at = k + 1
        if s.text(at) == "<":
            stop = s.angle_end(at, min(len(s.tokens), at + 24))
            at = stop if stop > at and s.text(stop) == "(" else at
        if s.text(at) != "(" or s.text(k - 1) in ("new", "function"):
            return
        if s.text(k - 1) in (".", "?."):
            receiver, plain = s.text(k - 2), s.kind(k - 2) == "word" and s.text(k - 3) not in (".", "?.")
            known = next((f[receiver] for f in reversed(scopes) if receiver in f), None) if plain else None
            typed = known or (receiver if plain and receiver[:1].isupper() else None)
            self.out.ref(source, "calls", name, type=typed)
        else:
            self.out.ref(source, "calls", name)


def extract(path: str, language: str | None, text: str) -> Builder:
    script = _Script(path, language, text)
    script.statements(0, len(script.s.tokens), top=True)
    return script.out.finish()

"""Python sources by the standard library's parser; a file it can't parse falls back to lines."""

from __future__ import annotations

import ast
import warnings

from . import lines
from .base import Builder

_ENUMS = frozenset("Enum Flag IntEnum IntFlag ReprEnum StrEnum".split())
_ABSTRACT = frozenset("ABC ABCMeta Protocol".split())


def _last(node: ast.expr | None) -> str:
    """The bare name of a name, attribute, subscript or quoted type."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return node.attr
    if isinstance(node, ast.Subscript):
        return _last(node.value)
    return ""


def _type_names(node: ast.expr | None) -> list[str]:
    """Every type that an annotation names, inside generics, unions and quotes too."""
    if node is None:
        return []
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        try:
            return _type_names(ast.parse(node.value, mode="eval").body)
        except SyntaxError:
            return []
    if isinstance(node, (ast.Name, ast.Attribute)):
        return [_last(node)]
    if isinstance(node, ast.Subscript):
        inner = [] if _last(node.value) == "Literal" else _type_names(node.slice)
        return [_last(node.value), *inner]
    if isinstance(node, ast.BinOp):
        return _type_names(node.left) + _type_names(node.right)
    if isinstance(node, (ast.Tuple, ast.List)):
        return [n for e in node.elts for n in _type_names(e)]
    return []


class _Walk:
    def __init__(self, path: str, language: str | None, text: str):
        self.out = Builder(path, language)
        self.lines = text.split("\n")
        self.scopes: list[dict[str, str]] = []

    def decl(self, node) -> str:
        first = node.body[0].lineno if node.body else node.end_lineno
        return "\n".join(self.lines[node.lineno - 1 : max(node.lineno, first - 1)]).strip()

    def bound_parameters(self, node, source: str) -> set[str]:
        names = set()
        for p in getattr(node, "type_params", []):
            names.add(p.name)
            for name in _type_names(getattr(p, "bound", None)):
                self.out.type_ref(source, "bound", name)
        return names

    def module(self, tree: ast.Module) -> None:
        for stmt in tree.body:
            self.statement(stmt, top=True)

    def statement(self, stmt: ast.stmt, top: bool = False, owner: str | None = None, owner_id: str | None = None, current: str | None = None) -> None:
        out = self.out
        if isinstance(stmt, ast.ClassDef):
            self.class_def(stmt, top)
        elif isinstance(stmt, (ast.FunctionDef, ast.AsyncFunctionDef)):
            self.function(stmt, top, owner, owner_id)
        elif isinstance(stmt, (ast.Import, ast.ImportFrom)):
            for alias in stmt.names:
                bound = alias.asname or alias.name.split(".")[0]
                if bound != "*":
                    out.ref(out.file_id, "imports", bound)
        elif top and isinstance(stmt, ast.AnnAssign) and _last(stmt.annotation) == "TypeAlias" and isinstance(stmt.target, ast.Name):
            self.alias(stmt.target.id, stmt)
        elif top and type(stmt).__name__ == "TypeAlias":
            self.alias(stmt.name.id, stmt)
        elif top and isinstance(stmt, ast.Assign) and isinstance(stmt.value, ast.Call) and _last(stmt.value.func) == "TypeVar":
            for kw in stmt.value.keywords:
                if kw.arg == "bound":
                    for name in _type_names(kw.value):
                        out.type_ref(out.file_id, "bound", name)
        else:
            for inner in ast.iter_child_nodes(stmt):
                if isinstance(inner, ast.stmt):
                    self.statement(inner, False, owner, owner_id, current)

    def alias(self, name: str, stmt: ast.stmt) -> None:
        self.out.add_def("type_alias", name, stmt.lineno, stmt.end_lineno, self.lines[stmt.lineno - 1].strip())
        self.out.export("local", name)

    def class_def(self, node: ast.ClassDef, top: bool) -> None:
        out, bases = self.out, [_last(b) for b in node.bases]
        is_enum = any(b in _ENUMS for b in bases)
        abstract = any(b in _ABSTRACT for b in bases) or any(k.arg == "metaclass" for k in node.keywords)
        id_ = out.add_def("enum" if is_enum else "class", node.name, node.lineno, node.end_lineno, self.decl(node), abstract="true" if abstract else None)
        if top:
            out.export("local", node.name)
        out.type_parameters.append(self.bound_parameters(node, id_))
        for base in bases:
            if base not in ("Generic",):
                out.ref(id_, "inherits", base)
        for stmt in node.body:
            if is_enum and isinstance(stmt, ast.Assign):
                for target in stmt.targets:
                    name = target.id if isinstance(target, ast.Name) else ""
                    if name and name != "_ignore_" and not (name.startswith("__") and name.endswith("__")):
                        out.add_def("enum_variant", name, stmt.lineno, stmt.end_lineno, name, owner=node.name, container=id_, label=f"{node.name}::{name}")
            elif isinstance(stmt, ast.AnnAssign) and isinstance(stmt.target, ast.Name):
                for name in _type_names(stmt.annotation):
                    out.type_ref(id_, "field", name, field=stmt.target.id)
            else:
                self.statement(stmt, False, node.name, id_)
        out.type_parameters.pop()

    def function(self, node, top: bool, owner: str | None, owner_id: str | None) -> None:
        out = self.out
        marks = [_last(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list]
        returned = _type_names(node.returns)
        id_ = out.add_def("function", node.name, node.lineno, node.end_lineno, self.decl(node), owner=owner, container=owner_id, abstract="true" if owner and ("abstractmethod" in marks or self.stub(node)) else None, returns=_last(node.returns) or (returned[0] if returned else None))
        if top:
            out.export("local", node.name)
        out.type_parameters.append(self.bound_parameters(node, id_))
        scope: dict[str, str] = {"self": owner, "cls": owner} if owner else {}
        args = node.args
        for arg in [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]:
            for name in _type_names(arg.annotation):
                out.type_ref(id_, "param", name, skip=node.name)
            if arg.annotation is not None and (known := _type_names(arg.annotation)):
                scope[arg.arg] = known[0]
        for name in returned:
            out.type_ref(id_, "return", name, skip=node.name)
        self.scopes.append(scope)
        for stmt in node.body:
            self.body(stmt, id_)
        self.scopes.pop()
        out.type_parameters.pop()

    @staticmethod
    def stub(node) -> bool:
        """A body of nothing but a docstring and ... or raise NotImplementedError."""
        rest = [s for s in node.body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str))]
        if len(rest) != 1:
            return False
        only = rest[0]
        if isinstance(only, ast.Raise) and only.exc is not None:
            return _last(only.exc.func if isinstance(only.exc, ast.Call) else only.exc) == "NotImplementedError"
        return isinstance(only, ast.Expr) and isinstance(only.value, ast.Constant) and only.value.value is Ellipsis

    def body(self, node: ast.AST, current: str) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            self.function(node, False, None, None)
            return
        if isinstance(node, ast.ClassDef):
            self.class_def(node, False)
            return
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            self.statement(node)
            return
        if isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name) and (known := _type_names(node.annotation)):
            self.scopes[-1][node.target.id] = known[0]
        if isinstance(node, ast.Call):
            self.call(node, current)
        for inner in ast.iter_child_nodes(node):
            self.body(inner, current)

    def call(self, node: ast.Call, current: str) -> None:
        func = node.func
        if isinstance(func, ast.Name):
            self.out.ref(current, "calls", func.id)
        elif isinstance(func, ast.Attribute) and isinstance(func.value, ast.Name):
            receiver = func.value.id
            known = next((s[receiver] for s in reversed(self.scopes) if receiver in s), None)
            typed = known or (receiver if receiver[:1].isupper() else None)
            if typed:
                self.out.ref(current, "calls", func.attr, type=typed)


def extract(path: str, language: str | None, text: str) -> Builder:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return lines.extract(path, language, text)
    walk = _Walk(path, language, text)
    walk.module(tree)
    return walk.out.finish()

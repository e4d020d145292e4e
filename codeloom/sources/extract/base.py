"""What an extractor builds of one file: nodes, contained-in edges, references and exports."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Container

NOISE = {
    "rust": frozenset(
        "Arc BTreeMap BTreeSet BinaryHeap Box Cow Duration Future HashMap HashSet Instant LinkedList Mutex Option Path PathBuf Pin Poll Rc RefCell Result"
        " RwLock Stream String SystemTime Vec VecDeque Waker bool char f32 f64 i128 i16 i32 i64 i8 isize str u128 u16 u32 u64 u8 usize".split()
    ),
    "python": frozenset(
        "Annotated Any AsyncContextManager AsyncGenerator AsyncIterable AsyncIterator AsyncMock Awaitable Callable ClassVar Concatenate ContextManager Coroutine Dict Ellipsis False"
        " Final Generator Iterable Iterator List Literal MagicMock Mapping Mock MutableMapping MutableSequence NonCallableMagicMock NonCallableMock None Optional ParamSpec PropertyMock"
        " Sequence Set True Tuple Type TypeVar Union bool bytearray bytes complex dict float int list object patch sentinel set str tuple".split()
    ),
    "typescript": frozenset(
        "Array Buffer Exclude Extract InstanceType Map Object Omit Parameters Partial Pick Promise Readonly ReadonlyArray ReadonlyMap ReadonlySet Record Required ReturnType Set"
        " WeakMap WeakSet any bigint boolean never null number string symbol undefined unknown void".split()
    ),
}
NOISE["javascript"] = NOISE["typescript"]
_json = json.JSONEncoder(ensure_ascii=False).encode
PREFIX = {"function": "fn", "type_alias": "type_alias"}


def fnv32(text: str) -> str:
    """The low half of the text's 64-bit FNV-1a hash as eight hex digits."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h & 0xFFFFFFFF:08x}"


class Builder:
    def __init__(self, path: str, language: str | None):
        self.path, self.language = path, language or ""
        self.file_id = f"file:{path}"
        self.nodes: list[dict] = []
        self.edges: list[dict] = []
        self.refs: list[dict] = []
        self.exports: list[dict] = []
        self.local_types: set[str] = set()
        self.type_parameters: list[set[str]] = []
        self.noise = {"considered": 0, "filtered": 0}
        self._bases: dict[str, tuple[str, str]] = {}
        self._count = 0
        self._node(self.file_id, path, "file", None, None, {"language": language} if language else {})

    def _node(self, id_: str, label: str, kind: str, start: int | None, end: int | None, attrs: dict) -> dict:
        node = {"id": id_, "label": label, "kind": kind, "source_file": self.path, "span_start": start, "span_end": end, "attrs": dict(attrs)}
        self.nodes.append(node)
        return node

    def add_def(self, kind: str, name: str, start: int, end: int, decl: str, owner: str | None = None, container: str | None = None, label: str | None = None, **attrs: str) -> str:
        """A definition under its container; its id is provisional until finish()."""
        prefix = PREFIX.get(kind, "variant" if kind == "enum_variant" else "type")
        base = f"{prefix}:{self.path}:{owner + '::' if owner else ''}{name}"
        self._count += 1
        provisional = f"{base}~{self._count}~"
        self._bases[provisional] = (base, decl)
        if owner:
            attrs["impl"] = owner
        self._node(provisional, label or name, kind, start, end, {k: v for k, v in attrs.items() if v is not None})
        relation = "has_variant" if kind == "enum_variant" else "contains"
        self.edges.append({"source": container or self.file_id, "relation": relation, "target_id": provisional})
        if prefix == "type":
            self.local_types.add(name)
        return provisional

    def ref(self, source: str, relation: str, name: str, **hints: str | None) -> None:
        if name:
            self.refs.append({"source": source, "relation": relation, "name": name, **{k: v for k, v in hints.items() if v is not None}})

    def type_ref(self, source: str, slot: str, name: str, skip: str | None = None, **hints: str | None) -> None:
        """A type/<slot> reference, held back until all local types are known."""
        scoped = any(name in frame for frame in self.type_parameters)
        if not scoped and name != skip:
            self.ref(source, f"type/{slot}", name, _filter="1", **hints)
        elif scoped:
            self.noise["considered"] += 1
            self.noise["filtered"] += 1

    def is_noise(self, name: str) -> bool:
        name = name.strip()
        return not name or (name not in self.local_types and name.rsplit("::", 1)[-1] in NOISE.get(self.language, ()))

    def export(self, kind: str, name: str | None = None, specifier: str | None = None, imported: str | None = None) -> None:
        self.exports.append({"pos": len(self.exports), "kind": kind, "name": name, "specifier": specifier, "imported": imported})

    def node(self, id_: str) -> dict:
        return next(n for n in reversed(self.nodes) if n["id"] == id_)

    def reparent(self, target: str, container: str) -> None:
        for edge in self.edges:
            if edge["target_id"] == target and edge["relation"] == "contains":
                edge["source"] = container

    def finish(self) -> Builder:
        """Final ids: those of one base all take a hash of their declaration, equal declarations a number besides."""
        times = Counter(base for base, _ in self._bases.values())
        final, used = {}, set()
        for node in self.nodes:
            if node["id"] not in self._bases:
                continue
            base, decl = self._bases[node["id"]]
            chosen = base
            if times[base] > 1:
                chosen, k = f"{base}#{fnv32(decl)}", 1
                while chosen in used:
                    chosen = f"{base}#{fnv32(decl)}~{k}"
                    k += 1
                used.add(chosen)
            final[node["id"]] = chosen
        for node in self.nodes:
            node["id"] = final.get(node["id"], node["id"])
        for edge in self.edges:
            edge["source"] = final.get(edge["source"], edge["source"])
            edge["target_id"] = final.get(edge["target_id"], edge["target_id"])
        kept = []
        for ref in self.refs:
            if ref.pop("_filter", None):
                self.noise["considered"] += 1
                if self.is_noise(ref["name"]):
                    self.noise["filtered"] += 1
                    continue
            ref["source"] = final.get(ref["source"], ref["source"])
            kept.append(ref)
        self.refs = kept
        return self

    def rows(self, tags: Container[str] | None = None) -> list[dict]:
        """Tagged rows for a DataFrame: one JSON body for each node, edge, reference and export, or only those of some tags."""
        tagged = [("node", n) for n in self.nodes] + [("edge", e) for e in self.edges] + [("ref", r) for r in self.refs] + [("export", e) for e in self.exports]
        return [{"path": self.path, "tag": tag, "pos": k, "body": _json(body)} for k, (tag, body) in enumerate(tagged) if tags is None or tag in tags]

"""Answers as text for people and tools, within a token budget."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row

BYTES_A_TOKEN = 3
MOST_CHARACTERS = 256


def clean(text: object) -> str:
    return "".join(c for c in str(text) if unicodedata.category(c) != "Cc")[:MOST_CHARACTERS]


def node_line(row: Row | dict) -> str:
    r = row.asDict() if isinstance(row, Row) else row
    where = f" ({clean(r['source_file'])})" if r.get("source_file") else ""
    home = f" [{clean(r['community'])}]" if r.get("community") else ""
    return f"NODE {clean(r['label'])} {clean(r['kind'])} {clean(r['id'])}{where}{home}"


def edge_line(row: Row | dict) -> str:
    r = row.asDict() if isinstance(row, Row) else row
    target = r["target_id"] if r.get("target_id") is not None else f"?{r.get('target_name')}"
    return f"EDGE {clean(r['source'])} -{clean(r['relation'])}-> {clean(target)} {r['confidence']}"


def within_budget(body: str, tokens: int) -> tuple[str, int]:
    """(body cut at a line break to the budget, NODE lines left out)."""
    most = tokens * BYTES_A_TOKEN
    raw = body.encode()
    if len(raw) <= most:
        return body, 0
    head = raw[:most].decode("utf-8", "ignore")
    head = head[: head.rfind("\n") + 1] if "\n" in head else ""
    rest = body[len(head) :]
    return head, sum(line.startswith("NODE ") for line in rest.split("\n"))


def region_text(nodes: Iterable[Row], edges: Iterable[Row], tokens: int = 2000) -> str:
    lines = [node_line(n) for n in nodes]
    if not lines:
        return "nothing matches\n"
    text, left = within_budget("\n".join([*lines, *(edge_line(e) for e in edges)]) + "\n", tokens)
    return text + (f"... {left} more nodes\n" if left else "")


def path_text(steps: list[dict]) -> str:
    if not steps:
        return "no path\n"
    return "".join(clean(s["label"]) if not k else f" -{s['relation']}/{s['confidence'] or '?'}-> {clean(s['label'])}" for k, s in enumerate(steps)) + "\n"


def report_markdown(report: dict[str, DataFrame], most: int = 50) -> str:
    """The report as Markdown; of long tables the first most rows, with the number of all."""

    def section(title: str, frame: DataFrame, columns: list[str]) -> list[str]:
        rows = frame.limit(most).collect()
        out = [f"## {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
        for r in rows:
            cells = (", ".join(map(str, r[c])) if isinstance(r[c], list) else r[c] for c in columns)
            out.append("| " + " | ".join(clean("" if c is None else c).replace("|", "\\|") for c in cells) + " |")
        if len(rows) == most:
            out += ["", f"{frame.count()} rows in all"]
        return [*out, ""]

    lines = ["# Graph report", ""]
    lines += section("Projects", report["projects"], "root name manifest files depends_on".split())
    lines += section("Totals", report["stats"], ["n_nodes", "n_edges", "n_communities"])
    lines += section("Confidence", report["confidence"], ["confidence", "n", "percent"])
    lines += section("Most connected nodes", report["god_nodes"], ["label", "kind", "id", "degree"])
    lines += section("Communities", report["communities"], ["community_id", "label", "size", "permille"])
    lines += section("Bridges", report["bridges"], ["from_community", "to_community", "source", "relation", "target_id"])
    return "\n".join(lines)

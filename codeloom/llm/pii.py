"""Personal data: exact base patterns, and further candidate spans chosen by boosted trees.

The base patterns' spans always stay. Generators with high recall propose further, overlapping spans of the same
kinds (obfuscated addresses, national phone numbers, cards with other separators, long-form addresses); trees over
format and context score them, and those above their kind's calibrated threshold that overlap nothing chosen stay.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .boosting import Boosted
from .common import small_batches, texts

KINDS = ("email", "ip", "card", "phone")
#: Share of chosen candidates that must be right, by which the thresholds are set.
PRECISION = 0.99
#: Labelled candidates that the trees are grown and calibrated on.
EXAMPLES = 6000
#: Candidates of a text that are scored at once.
SCORED = 4096
Span = tuple[int, int, int]  # kind, start, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Leftmost, non-overlapping; each local part is looked up leftwards from its @, so long words cost no rescans."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            free = found.end()
            yield 0, start, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans in kind order, then by start."""
    if not _ANY.search(text):
        return []
    out = list(_emails(text)) if "@" in text else []
    if text.count(".") > 2:
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) < 4 and int(p or 0) < 256 for part in m.group().split(".")):
                out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _digits(m.group())) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


_AT = re.compile(r"\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?|\s(?:at|AT)\s(?=[A-Za-z0-9-]++\s(?:dot|DOT)\s)|\uff20")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?|\s(?:dot|DOT)\s|\.)[A-Za-z0-9-]++)++")
_NUMBER = re.compile(r"(?<![0-9.+-])\(?[0-9]{2,8}\)?(?:[\x20./-]{1,2}[0-9]{2,8}){1,5}(?![0-9])|(?<![0-9.,+-])[0-9]{9,12}(?![0-9.,])")
_GROUPS = re.compile(r"(?<![0-9])[0-9]{4}(?:[._/\x20-]{1,2}[0-9]{3,6}){2,4}(?![0-9])")
_LONG_IP = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_SPLIT_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?[\[({]\.[\])}]\s?[0-9]{1,3}){3}(?![0-9])")


def candidates(text: str) -> list[Span]:
    """Spans that may be personal data beside the base patterns, overlapping ones included, in time linear in the text."""
    out: list[Span] = []
    free = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        free = m.end()
        host = _HOST.match(text, free) if start < m.start() else None
        if host:
            out.append((0, start, host.end()))
    if ":" in text:
        out += [(1, m.start(), m.end()) for m in _LONG_IP.finditer(text)]
    if _ANY.search(text):
        out += [(1, m.start(), m.end()) for m in _SPLIT_IP.finditer(text)]
        out += [(2, m.start(), m.end()) for m in _GROUPS.finditer(text) if 13 <= len(_digits(m.group())) <= 19]
        out += [(3, m.start(), m.end()) for m in _NUMBER.finditer(text) if 7 <= len(_digits(m.group())) <= 12]
    return out


_CUES = (
    re.compile(r"(?:mail|contact|write|schreib|correo|courriel)", re.I),
    re.compile(r"(?:\bip\b|host|server|address|addr|ping|login)", re.I),
    re.compile(r"(?:card|visa|credit|karte|carte|tarjeta|payment|iban)", re.I),
    re.compile(r"(?:phone|\btel|call|mobile|fax|cell|telefon|t[eé]l[eé]phone|ruf|llam|appel|whatsapp|\bsms)", re.I),
    re.compile(r"(?:version|\bv\.?$|order|invoice|isbn|serial|ticket|\bid\b|part|article|ratio|pages?|date|jahr|year|build|score|between|lot|ref)", re.I),
)


def features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    inside = text[start:end]
    before, after = text[max(0, start - 28) : start], text[end : end + 16]
    digits = _digits(inside)
    groups = [len(g) for g in re.findall(r"[0-9]+", inside)] or [0]
    ahead = before[-1:] or " "
    last = re.split(r"[^0-9A-Za-z]+", inside)[-1]
    return [
        kind, len(inside), len(digits), len(groups), max(groups), min(groups), groups[-1], groups[0], float(luhn(digits)) if digits else 0.0,
        len(set(c for c in inside if not c.isalnum())), float("(" in inside), float("." in inside), float("/" in inside), float("-" in inside), float(":" in inside),
        sum(c.isalpha() for c in inside), float(ahead.isalnum()), float(ahead in "$€#=_/"), float(after[:1].isalnum() or after[:1] in "%$€_"),
        float(bool(re.match(r"\s?(?:km|kg|cm|mm|eur|usd|%|€|\$|pages|pm|am|h\b)", after, re.I))),
        float(bool(re.search(r"(?:19|20)[0-9]{2}", inside))), len(set(digits)), *(float(bool(cue.search(before))) for cue in _CUES),
        float(bool(re.search(r"dot|at|@", inside, re.I))), float(sum(c.isspace() for c in inside)), float(bool(re.search(r"[\[({<]", inside))),
        float(len(last)), float(last.isalpha() and last.islower()),
    ]


def _example(rng: random.Random) -> tuple[str, Span, int] | None:
    """A made-up sentence with one candidate, and whether it is personal data."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("an", "er", "the", "on", "re", "in", "es", "ou", "ti", "ha", "is", "schl", "que", "os")) for _ in range(rng.randint(1, 3)))
    sep, yes, kind = rng.choice(" -./"), rng.random() < 0.5, rng.randrange(4)
    cue, item = word(), ""
    if kind == 0:
        brackets = rng.choice(("[]", "()", "{}"))
        at = rng.choice((" {}at{} ", "{}at{}", " {} at {} ", "{}@{}", " at ", "\uff20")).format(*brackets)
        item = f"{word()}{rng.choice(('.', '_', ''))}{word()}{at}{word()}{' dot ' if at == ' at ' else rng.choice(('.', f' {brackets[0]}dot{brackets[1]} '))}{rng.choice(('com', 'org', 'de', 'net', 'fr', 'es', 'it', 'no', 'uk', 'io', 'info', 'edu'))}"
        if not yes:
            item = f"{word()} {brackets[0]}at{brackets[1]} {word()}.{rng.choice((word().capitalize(), d(2)))}"
            item = item if rng.random() < 0.6 else f"{word()} at {word()} dot {rng.choice(('and', 'the', 'in', 'on', word(), word() + word(), d(1)))}"
        cue = rng.choice((cue, "mail", "contact", "write to")) if yes else cue
    elif kind == 1:
        item = ":".join("".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(2, 4))) for _ in range(8 if yes else rng.randint(3, 6)))
        item = item if yes or rng.random() < 0.3 else ":".join(d(2) for _ in range(3))
        if rng.random() < 0.3:
            item = rng.choice(("[.]", "(.)", " [.] ")).join(str(rng.randint(0, 255) if yes else rng.randint(256, 999)) for _ in range(4))
        elif yes and rng.random() < 0.4:
            item = ":".join(("2001", "db8", "", f"{rng.randint(1, 65535):x}", f"{rng.randint(1, 65535):x}")) if rng.random() < 0.5 else f"fe80::{rng.randint(1, 65535):x}:{rng.randint(1, 65535):x}"
        cue = rng.choice((cue, "host", "ip", "server")) if yes else rng.choice((cue, "date", "version", "ratio"))
    elif kind == 2:
        number = d(15)
        number = next(number + c for c in "0123456789" if luhn(number + c)) if yes else d(16)
        sep = rng.choice((".", "_", "/", "  ", " - "))
        item = sep.join(number[k : k + 4] for k in range(0, 16, 4))
        yes = luhn(number)
        cue = rng.choice((cue, "card", "visa", "credit card")) if yes else rng.choice((cue, "serial", "order", "invoice"))
    elif yes:
        item = rng.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{sep}{d(3)}{sep}{d(4)}", f"0{d(3)}{rng.choice('/ -')}{d(6)[:5]}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(2)}{sep}{d(7)}", f"0{d(9)}", f"0{d(3)} {d(7)}"))
        cue = rng.choice(("call", "phone", "tel.", "fax", "mobile", "Telefon", cue))
    else:
        item = rng.choice((f"{rng.randint(1900, 2099)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.{rng.randint(1900, 2099)}", f"{d(3)} {d(3)} {d(3)}", f"{d(3)}-{d(2)}-{d(5)}", f"{d(4)}/{d(4)}", f"{d(3)}.{d(3)}.{d(2)}", f"{d(4)}-{d(4)}", f"{d(2)} {d(3)} {d(3)}", d(9), d(10), f"{d(3)}-{d(6)}", f"{d(2)}/{d(6)}"))
        cue = rng.choice((cue, "order", "version", "isbn", "invoice", "pages", "date", "between", cue, cue))
    text = f"{word()} {word()} {cue}{rng.choice((' ', ': '))}{item}{rng.choice((' ', '. ', ', ', ' km ' if kind == 3 and not yes else ' '))}{word()} {word()}"
    found = [s for s in candidates(text) if s[0] == kind]
    if not found:
        return None
    return text, max(found, key=lambda s: s[2] - s[1]), int(yes)


def _examples(rng: random.Random, n: int) -> tuple[np.ndarray, np.ndarray]:
    made = (x for x in iter(lambda: _example(rng), 0) if x)
    chosen = [next(made) for _ in range(n)]
    return np.array([features(text, span) for text, span, _ in chosen], float), np.array([truth for *_, truth in chosen], float)


@lru_cache(maxsize=1)
def model() -> tuple[Boosted, tuple[float, ...]]:
    """The trees and each kind's threshold: always the same ones. Trees are grown on half of EXAMPLES made-up candidates, scores
    are calibrated on the other half, and thresholds set on half as many others that neither saw."""
    rng = random.Random(20240229)
    fitted = Boosted().fit(*_examples(rng, EXAMPLES))
    x, y = _examples(rng, EXAMPLES // 2)
    score, limits = fitted.score(x), []
    for kind in range(len(KINDS)):
        held = np.nonzero(x[:, 0] == kind)[0]
        order = held[np.argsort(-score[held], kind="stable")]
        right = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
        good = np.nonzero(right >= PRECISION)[0]
        limits.append(max(0.5, float(score[order[good[-1]]])) if len(good) else 2.0)
    return fitted, tuple(limits)


class _Taken:
    """Stretches of a text that are taken; asking costs the logarithm of their number."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end in sorted(spans, key=lambda s: s[1]):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start

    def take(self, start: int, end: int) -> None:
        """A stretch that meets none taken before."""
        k = bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


def added_spans(text: str, base: list[Span], fitted: Boosted, limits: tuple[float, ...]) -> list[Span]:
    """The candidates chosen: best score first, none that overlaps a base span or a chosen one."""
    taken = _Taken(base)
    proposed = [c for c in dict.fromkeys(candidates(text)) if not taken.meets(c[1], c[2])]
    if not proposed:
        return []
    score = np.concatenate([fitted.score(np.array([features(text, c) for c in proposed[a : a + SCORED]], float)) for a in range(0, len(proposed), SCORED)])
    out: list[Span] = []
    for k in sorted(range(len(proposed)), key=lambda k: (-score[k], proposed[k][1], proposed[k])):
        kind, start, end = proposed[k]
        if score[k] >= limits[kind] and not taken.meets(start, end):
            out.append(proposed[k])
            taken.take(start, end)
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def redacted(text: str, spans: list[Span]) -> str:
    """text with each stretch of overlapping spans replaced by its first kind's name in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted), a row for every row.

    The counts and base_sha256 are of the base spans, spans lists all; offsets are code points, ends exclusive.
    redacted is the text with its spans replaced. A null or empty text has no spans; repeated rows stay repeated;
    an empty table gives an empty result. Each row is done alone, without an exchange, in time in proportion to its
    text but for the sorting of its spans.
    """
    fitted = model()
    fields = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"
    schema = pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in fields.split(", ")])

    def run(batches):
        for batch in batches:
            rows, text = [], batch.column("text")
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                t = text[k].as_py()
                base = base_spans(t)
                every = base + added_spans(t, base, *fitted)
                counts = [sum(s[0] == kind for s in base) for kind in range(len(KINDS))]
                rows.append((doc, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), redacted(t, every)))
            columns = list(zip(*rows)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return texts(docs).mapInArrow(run, fields)


def redact_texts(docs: DataFrame) -> DataFrame:
    """docs(text, ...) with the same columns and rows, its texts redacted; a null text stays null, an empty one
    empty, n_chars follows if it is there. Repeated rows stay; an empty table gives an empty result."""
    small_batches(docs.sparkSession)
    fitted = model()

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            base = base_spans(t) if t else []
            out.append(redacted(t, base + added_spans(t, base, *fitted)) if t else t)
        return pd.Series(out, dtype=object)

    docs = docs.withColumn("text", clean(docs["text"].cast("string")))
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs

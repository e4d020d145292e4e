"""Language identification by Bayesian fusion of text likelihood, declared language, address suffix and host prior."""

from __future__ import annotations

import html as html_entities
import re
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, id_type, small_batches

#: Labelled rows of each language that the text likelihoods are fitted on at most: those of least hashed id and text.
SAMPLE = 3000
CELLS = 1 << 15
#: Trigrams beyond which a text gives no more evidence, since neighbours aren't independent. In the fit all of a longer text is
#: counted, but weighs as so many.
EVIDENCE = 120
#: Trigrams below which an odd text isn't taken for one without a language: its declaration and host decide.
FEW = 10
#: Pseudo-rows that a level of the prior lends to the one below it.
SMOOTHING = 5.0
#: Share of rows whose declared language may be anything.
DOUBT = 0.02
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """Log-likelihoods of hashed byte trigrams for each language, and the mean one below which no language fits."""

    languages: tuple[str, ...]
    table: np.ndarray
    floor: float


def _cells(text: str) -> np.ndarray:
    """Hashed trigrams of the text's lower-cased letters; what isn't a letter is one space, as are both ends."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    if not letter.any():
        return np.zeros(0, np.int64)
    raw = np.r_[np.uint8(32), np.where(letter, raw, 32), np.uint8(32)].astype(np.uint8)
    raw = raw[np.r_[True, (raw[1:] != 32) | (raw[:-1] != 32)]]
    a, b, c = (raw[k : len(raw) - 2 + k].astype(np.uint32) for k in range(3))
    return ((a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + c * np.uint32(0xC2B2AE3D)) >> np.uint32(17)).astype(np.int64)


def _sampled(labelled: DataFrame, text: str, language: str, key: str, sample: int) -> tuple[list[str], DataFrame]:
    """(every label, (l, t): the sample rows of least hash of each, all if they are fewer). A label's rows of any length count."""
    rows = labelled.select(labelled[language].cast("string").alias("l"), labelled[text].cast("string").alias("t"), labelled[key].alias("k"))
    rows = rows.where(F.col("l").isNotNull() & F.col("t").isNotNull()).select("l", "t", F.xxhash64("k", "t").alias("h"))
    sizes = rows.groupBy("l").agg(F.count("*").alias("n"), F.min("h").alias("least"))
    sizes = sizes.collect()
    if not sizes:
        return [], rows.select("l", "t")
    # only about twice the sample's rows of a label leave their tasks, however many tasks there are, and one at least
    bounds = [(r["l"], max(r["least"], int(-(1 << 63) + (1 << 64) * (2 * sample / r["n"]))) if r["n"] > 2 * sample else (1 << 63) - 1) for r in sizes]
    bounds = labelled.sparkSession.createDataFrame(bounds, "l string, most long")
    rows = rows.join(F.broadcast(bounds), "l").where("h <= most")
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).where(F.col("at") <= sample)
    return sorted(r["l"] for r in sizes), cut(rows.select("l", "t"))


def fit(labelled: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """The likelihoods from at most sample rows of each label; every label has a class. The floor is halfway from
    the usual mean to that of trigrams never seen, so only texts that are hardly in any language fall below it.

    Trigrams are counted where the rows are. Each language's counts weigh as much as the largest one's: a trigram
    never seen is as unlikely in a language of few rows as in one of many, so odd texts don't go to the rarest.
    """
    small_batches(labelled.sparkSession)
    found, rows = _sampled(labelled, text, language, key, sample)
    languages = tuple(found) or (UNKNOWN,)

    def count(batches):
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            for name, t in zip(batch.column("l").to_pylist(), batch.column("t")):
                mine = sums.setdefault(name, np.zeros(CELLS, np.int64))
                cells = _cells(t.as_py())
                mine += np.rint(np.bincount(cells, minlength=CELLS) * (1e6 * min(1, EVIDENCE / max(len(cells), 1)))).astype(np.int64)  # whole millionths: sums in any order agree
            for name, mine in sums.items():
                cells = np.nonzero(mine)[0]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(mine[cells])], names=["l", "cell", "n"])

    counts = np.zeros((len(languages), CELLS))
    if found:
        sums = rows.mapInArrow(count, "l string, cell int, n long").groupBy("l", "cell").agg(F.sum("n").alias("n")).toArrow()
        place = {name: k for k, name in enumerate(languages)}
        counts[[place[name] for name in sums.column("l").to_pylist()], sums.column("cell").to_numpy()] = sums.column("n").to_numpy() / 1e6
    totals = counts.sum(axis=1, keepdims=True)
    most = totals.max()
    counts = counts * (most / np.maximum(totals, 1)) + 0.05
    table = np.log(counts / (most + 0.05 * CELLS)).astype(np.float32)

    def mean(batches):
        for batch in batches:
            cells = (_cells(t.as_py()) for t in batch.column("t"))
            yield pa.RecordBatch.from_arrays([pa.array([float(table[:, c].mean(axis=1).max()) for c in cells if len(c) >= 10], pa.float64())], names=["mean"])

    means = np.sort(rows.select("t").mapInArrow(mean, "mean double").toArrow().column("mean").to_numpy()) if found else []
    floor = (float(means[len(means) // 2]) + float(table.min())) / 2 if len(means) else -99.0
    return Model(languages, table, floor)


def text_evidence(rows: DataFrame, model: Model) -> DataFrame:
    """rows(id, text, declared, suffix, domain, host) -> the same without text, with evidence array<double> and typical boolean.

    evidence is each language's log-likelihood, tempered to EVIDENCE trigrams; typical is false for a text
    without letters and for one of FEW trigrams or more that no language explains.
    """
    small_batches(rows.sparkSession)
    kind = id_type(rows, "id")
    fields = f"id {kind}, declared string, suffix string, domain string, host string, evidence array<double>, typical boolean"
    schema = pa.schema([("id", pa.binary() if kind == "binary" else pa.int64()), *((n, pa.string()) for n in ("declared", "suffix", "domain", "host")), ("evidence", pa.list_(pa.float64())), ("typical", pa.bool_())])

    def run(batches):
        for batch in batches:
            evidence, typical, text = [], [], batch.column("text")
            for k in range(batch.num_rows):
                cells = _cells(text[k].as_py() or "")
                n = len(cells)
                total = model.table[:, cells].sum(axis=1, dtype=np.float64) if n else np.zeros(len(model.languages))
                evidence.append((total * (min(n, EVIDENCE) / n if n else 0)).round(9).tolist())
                typical.append(bool(n and (n < FEW or total.max() / n >= model.floor)))
            columns = [batch.column(n) for n in ("id", "declared", "suffix", "domain", "host")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(evidence, schema.field("evidence").type), pa.array(typical)], schema=schema)

    return rows.mapInArrow(run, fields)


def _posterior(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    total = sum((F.exp(s - top) for s in scores), F.lit(0.0))
    return [F.exp(s - top) / total for s in scores]


def _shared(counts: DataFrame, above: DataFrame, keys: list[str], n: int) -> DataFrame:
    """counts(keys, n, c0..) smoothed by above's prior p0.. of the keys but the last -> (keys, n, c0.., p0..)."""
    joined = counts.join(above, keys[:-1]) if keys[:-1] else counts.crossJoin(F.broadcast(above))  # one row of global shares
    return joined.select(*keys, "n", *(f"c{k}" for k in range(n)), *(((F.col(f"c{k}") + SMOOTHING * F.col(f"p{k}")) / (F.col("n") + SMOOTHING)).alias(f"p{k}") for k in range(n)))


def fuse(rows: DataFrame, model: Model) -> DataFrame:
    """rows(id, declared, suffix, domain, host, evidence, typical) -> (id, language, confidence, declared, accepted).

    Text alone gives each row's first posterior. Grouped sums of those give the prior of each suffix, of each domain
    under it and of each host under that, each smoothed by the level above, and how often each declared language
    goes with each language. The last posterior multiplies the text's likelihood, the declaration's and the host's
    prior without the row itself. Ties go to the first language in order.
    """
    n = len(model.languages)
    first = _posterior([F.col("evidence")[k] for k in range(n)])
    rows = cut(rows.select("*", *(F.when(F.col("typical"), p).otherwise(0.0).alias(f"q{k}") for k, p in enumerate(first))))
    sums = [F.sum(f"q{k}").alias(f"c{k}") for k in range(n)]
    again = [F.sum(f"c{k}").alias(f"c{k}") for k in range(n)]
    weight = F.sum(F.col("typical").cast("double")).alias("n")
    hosts = rows.groupBy("suffix", "domain", "host").agg(weight, *sums)
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), *again)
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), *again)
    whole = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), *(F.coalesce(F.sum(f"c{k}"), F.lit(0.0)).alias(f"c{k}") for k in range(n)))
    world = whole.select(*(((F.col(f"c{k}") + SMOOTHING / n) / (F.col("n") + SMOOTHING)).alias(f"p{k}") for k in range(n)))
    prior = lambda df: df.select(*[c for c in ("suffix", "domain") if c in df.columns], *(f"p{k}" for k in range(n)))
    by_suffix = _shared(suffixes, world, ["suffix"], n)
    by_domain = _shared(domains, prior(by_suffix), ["suffix", "domain"], n)
    parents = prior(by_domain)
    hosts = hosts.join(parents, ["suffix", "domain"])
    # how often a declaration goes with a language: a row for each declared value
    declared = rows.where(F.col("declared").isNotNull()).groupBy("declared").agg(*(F.sum(f"q{k}").alias(f"d{k}") for k in range(n)))
    totals = rows.where(F.col("declared").isNotNull()).agg(*(F.coalesce(F.sum(f"q{k}"), F.lit(0.0)).alias(f"t{k}") for k in range(n)))
    declared = declared.crossJoin(F.broadcast(totals)).select("declared", *(F.log((F.col(f"d{k}") + 0.1) / (F.col(f"t{k}") + 1.0) * (1 - DOUBT) + DOUBT / n).alias(f"e{k}") for k in range(n)))
    joined = rows.join(hosts.withColumnRenamed("n", "hn"), ["suffix", "domain", "host"]).join(declared, "declared", "left")
    one = F.col("typical").cast("double")
    scores = []
    for k in range(n):
        host = (F.greatest(F.lit(0.0), F.col(f"c{k}") - F.col(f"q{k}")) + SMOOTHING * F.col(f"p{k}")) / (F.col("hn") - one + SMOOTHING)
        scores.append(F.col("evidence")[k] + F.log(F.greatest(host, F.lit(1e-6))) + F.coalesce(F.col(f"e{k}"), F.lit(0.0)))
    last = _posterior(scores)
    best = F.greatest(*(F.round(p, 9) for p in last)) if n > 1 else F.round(last[0], 9)
    named = F.coalesce(*(F.when(F.round(p, 9) == best, F.lit(name)) for p, name in zip(last, model.languages)))
    return joined.select("id", F.when(F.col("typical"), named).otherwise(F.lit(UNKNOWN)).alias("language"), F.round(best, 6).alias("confidence"), "declared", F.col("typical").alias("accepted"))


_DROP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.I | re.S)
_TAG = re.compile(r"<[^>]*>")
_HTML = re.compile(r"<html\b", re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def page_parts(url: str | None, page: str | None) -> tuple[str, str | None, str, str, str]:
    """(text, declared language, address suffix, domain, host) of a page; what can't be read is empty.

    The suffix is the last label of the host, with the first path segment if that is a two-letter code."""
    page = page or ""
    shown = _DROP.sub(" ", page)
    found = _LANG.search(shown if _HTML.search(shown) else page)  # the tag may be in conditional comments alone
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").lower()
    except ValueError:
        parts, host = None, ""
    labels = host.split(".")
    segment = parts.path.strip("/").split("/")[0].lower() if parts else ""
    suffix = labels[-1] + (f"/{segment}" if len(segment) == 2 and segment.isalpha() else "")
    text = html_entities.unescape(_TAG.sub(" ", shown))
    return text, found.group(1).lower() if found else None, suffix, ".".join(labels[-2:]), host


def identify_pages(pages: DataFrame, model: Model) -> DataFrame:
    """pages(page_id, url, html, ...) -> (page_id, language, confidence, declared, accepted), a row for every row.

    Null or empty pages are of unknown language; null addresses share one host. Repeated rows stay repeated and
    count as evidence each; an empty table gives an empty result.
    """
    names = ["id", "text", "declared", "suffix", "domain", "host"]

    def read(batches):
        for batch in batches:
            parts = [page_parts(u.as_py(), h.as_py()) for u, h in zip(batch.column("url"), batch.column("html"))]
            columns = list(zip(*parts)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.string()) for c in columns)], names=names)

    small_batches(pages.sparkSession)
    rows = pages.select(pages["page_id"].cast("long").alias("id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    rows = rows.mapInArrow(read, "id long, text string, declared string, suffix string, domain string, host string")
    return fuse(text_evidence(rows, model), model).withColumnRenamed("id", "page_id")


def identify_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, lang, source, ...) -> (doc_id, language, confidence, declared, accepted), a row for every row.

    The column lang is the declared language and source the host; nulls and repeated rows as in identify_pages.
    """
    rows = docs.select(
        docs["doc_id"].cast(id_type(docs)).alias("id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("declared"),
        F.lit("").alias("suffix"), F.lit("").alias("domain"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("host"),
    )
    return fuse(text_evidence(rows, model), model).withColumnRenamed("id", "doc_id")

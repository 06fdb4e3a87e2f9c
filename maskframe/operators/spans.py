"""Resolution of spans: equal ones, overlaps, thresholds, line ends.

The array forms keep everything in the document's row. :func:`resolve` is a fold over
the sorted array with built-in functions; a document with thousands of spans is folded
in an Arrow helper instead, as the built-in fold copies its array at every step.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import DEFAULT_PRIORITY, Catalog
from .detect import SPANS, once

SOURCES = {"pattern": 0, "ner": 1, "llm": 2}


def _priorities(catalog: Catalog) -> Column:
    pairs = [x for e in catalog.entities for x in (F.lit(e.id), F.lit(e.priority))]
    return F.create_map(*pairs) if pairs else F.create_map(F.lit(""), F.lit(DEFAULT_PRIORITY))


def _source_rank(source: Column) -> Column:
    out = F.lit(len(SOURCES))
    for name, rank in SOURCES.items():
        out = F.when(source == name, F.lit(rank)).otherwise(out)
    return out


def _better(a: Column, b: Column, priority: Column) -> Column:
    """Whether ``b`` wins against the earlier ``a``: confidence, priority, source, length; full ties stay with ``a``."""
    of = lambda s: F.coalesce(F.element_at(priority, s["entity_id"]), F.lit(DEFAULT_PRIORITY))
    rank = lambda s: F.struct(-s["confidence"], of(s), _source_rank(s["source"]), s["start"] - s["end"])
    return rank(b) < rank(a)


def dedupe(spans: Column) -> Column:
    """One span for each start, end and entity: the most confident, the first of equal ones. Sorted by start, then as found."""
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["seq"] - b["seq"])
    ordered = F.array_sort(spans, order)

    def beaten(s: Column) -> Column:
        same = lambda o: (o["start"] == s["start"]) & (o["end"] == s["end"]) & (o["entity_id"] == s["entity_id"])
        return F.exists(spans, lambda o: same(o) & ((o["confidence"] > s["confidence"]) | ((o["confidence"] == s["confidence"]) & (o["seq"] < s["seq"]))))

    return F.filter(ordered, lambda s: ~beaten(s))


def resolve_overlaps(spans: Column, catalog: Catalog) -> Column:
    """The fold over spans sorted by start: one that overlaps the last kept either replaces it or goes.

    What lost stays lost, even where the winner loses later. Spans that touch do not overlap.
    """
    priority = _priorities(catalog)

    def step(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        free = (F.size(kept) == 0) | (s["start"] >= last["end"])
        swapped = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(s))
        return F.when(free, F.concat(kept, F.array(s))).when(_better(last, s, priority), swapped).otherwise(kept)

    return F.aggregate(spans, F.array().cast(SPANS), step)


def fold(spans: list[dict], priority: dict[str, int]) -> list[dict]:
    """Equal spans and overlaps of one document, for the helper."""
    best: dict[tuple, dict] = {}
    for s in spans:
        key = (s["start"], s["end"], s["entity_id"])
        if key not in best or s["confidence"] > best[key]["confidence"]:
            best[key] = s
    rank = lambda s: (-s["confidence"], priority.get(s["entity_id"], DEFAULT_PRIORITY), SOURCES.get(s["source"], len(SOURCES)), s["start"] - s["end"])
    kept: list[dict] = []
    for s in sorted(best.values(), key=lambda s: (s["start"], s["seq"])):
        if not kept or s["start"] >= kept[-1]["end"]:
            kept.append(s)
        elif rank(s) < rank(kept[-1]):
            kept[-1] = s
    return kept


def trim_lines(spans: list[dict], ids: frozenset[str]) -> list[dict]:
    """:func:`trim_multiline` of one document's spans, for the helper."""
    out = []
    for s in spans:
        if s["entity_id"] in ids and "\n" in s["text"]:
            head = s["text"].split("\n", 1)[0].rstrip()
            if len(head) < 2:
                continue
            s = s | {"text": head, "end": s["start"] + len(head)}
        out.append(s)
    return out


def merge_all(spans: Column, catalog: Catalog) -> Column:
    """Equal spans, then overlaps, without thresholds."""
    priority = {e.id: e.priority for e in catalog.entities}

    @once
    @F.pandas_udf(SPANS)
    def long_fold(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: fold(list(r), priority) if r is not None else [])

    return long_fold(spans)


def merge_built_in(spans: Column, catalog: Catalog) -> Column:
    """:func:`merge_all` with built-in functions only, for documents of up to some hundred spans."""
    return resolve_overlaps(dedupe(spans), catalog)


def split_by_threshold(spans: Column, catalog: Catalog | None, default: float) -> tuple[Column, Column]:
    """Spans at or above their threshold, and the rest; an entity's own threshold goes before the default."""
    own = [x for e in (catalog.entities if catalog else ()) if e.confidence_threshold is not None for x in (F.lit(e.id), F.lit(e.confidence_threshold))]
    limit = (lambda s: F.coalesce(F.element_at(F.create_map(*own), s["entity_id"]), F.lit(default))) if own else (lambda s: F.lit(default))
    return F.filter(spans, lambda s: s["confidence"] >= limit(s)), F.filter(spans, lambda s: s["confidence"] < limit(s))


def merge(df: DataFrame, catalog: Catalog, threshold: float | None = None, spans: str = "spans") -> DataFrame:
    """Adds ``high`` and ``low``: merged spans by threshold."""
    out = df.withColumn("_merged", merge_all(F.col(spans), catalog))
    high, low = split_by_threshold(F.col("_merged"), catalog, catalog.default_threshold if threshold is None else threshold)
    return out.withColumns({"high": high, "low": low}).drop("_merged")


def trim_multiline(spans: Column, ids: frozenset[str] | tuple[str, ...]) -> Column:
    """Spans of the listed entities end before their first line feed; what is left of under two characters goes."""
    if not ids:
        return spans
    listed = lambda s: s["entity_id"].isin(*ids) & s["text"].contains("\n")
    head = lambda s: F.regexp_replace(F.substring_index(s["text"], "\n", 1), r"(?U)\s+$", "")
    kept = F.filter(spans, lambda s: ~(listed(s) & (F.length(head(s)) < 2)))
    return F.transform(kept, lambda s: F.when(listed(s), s.withField("text", head(s)).withField("end", s["start"] + F.length(head(s)))).otherwise(s))


def dedupe_table(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """:func:`dedupe` for a table with one span a row."""
    order = Window.partitionBy(key, "start", "end", "entity_id").orderBy(F.desc("confidence"), "seq")
    return spans.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")

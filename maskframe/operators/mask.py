"""Masking: numbers for the values of a document, masks by entity, and the text put together again."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.language import Languages
from ..functions.masking import mask_value
from ..functions.text import LEAST_LEAF, clean_text, guess_language, json_strings, strip
from .detect import SPAN, SPANS, Rules, Scorer, once, scan_safely, score_texts, span_arrays
from .spans import fold, trim_lines
from .tagger import in_parts

MAX_CHARS = 500_000
#: Size and overlap of the chunks that a model scores.
MODEL_CHUNKS = (1200, 100)
#: Characters of the texts that a task holds the spans of as objects.
SCANNED = 1 << 22


@dataclass(frozen=True)
class MaskOptions:
    """How documents are masked. ``key`` is needed only by keyed strategies. Texts of more than ``max_chars`` characters are rejected, not masked."""

    text: str = "text"
    language: str = "auto"
    max_chars: int = MAX_CHARS
    key: str | None = None
    keep_original: bool = False
    #: Recogniser of names (labels PERSON and ORG), and a model over chunks with its least score.
    tagger: Scorer | None = None
    scorer: Scorer | None = None
    threshold: float = 0.4
    #: A trained model of languages in place of the function words.
    languages: Languages | None = None


def guard(df: DataFrame, text: str = "text", max_chars: int = MAX_CHARS) -> DataFrame:
    """Adds reject_reason: empty, too_long or null."""
    t = F.col(text)
    return df.withColumn("reject_reason", F.when(t.isNull() | (strip(t) == ""), "empty").when(F.length(t) > max_chars, "too_long"))


#: What the helpers return for a text: its spans in order, the number of each value, and the texts between the spans that are masked.
PLACED = f"spans:{SPANS},n:array<int>,gaps:array<string>"


def number(spans: list[dict]) -> list[int]:
    """For each span of a document, in order, the place of its value among the different values of its entity, by first sight."""
    seen: dict[str, dict[str, int]] = {}
    out = []
    for s in spans:
        own = seen.setdefault(s["entity_id"], {})
        out.append(own.setdefault(s["text"], len(own) + 1))
    return out


def place(text: str, spans: list[dict], known: frozenset[str]) -> tuple[list[dict], list[int], list[str]]:
    """Spans by start, their numbers, and the pieces of ``text`` around the spans of ``known`` entities; one pass."""
    ordered = sorted(spans, key=lambda s: s["start"])
    gaps, upto = [], 0
    for s in ordered:
        if s["entity_id"] in known:
            gaps.append(text[upto : s["start"]])
            upto = s["end"]
    return ordered, number(ordered), [*gaps, text[upto:]]


def number_spans(spans: Column) -> Column:
    """The spans in order, each with ``n``: the place of its value among the different values of its entity.

    The values of an entity in the order of their first sight give the numbers, so equal values share one.
    """

    @once
    @F.pandas_udf(f"array<{SPAN[:-1]},n:int>>")
    def numbered(rows: pd.Series) -> pd.Series:
        ordered = [sorted(r, key=lambda s: s["start"]) if r is not None else [] for r in rows]
        return pd.Series([[s | {"n": n} for s, n in zip(o, number(o), strict=True)] for o in ordered], dtype=object)

    return numbered(spans)


def _with_numbers(placed: Column) -> Column:
    return F.transform(placed["spans"], lambda s, i: s.withField("n", F.get(placed["n"], i)))


def mask_spans_column(spans: Column, catalog: Catalog, key: str | None = None) -> Column:
    """Numbered spans as array of original, masked, entity_id, strategy, start, end; unknown entities are left out."""
    known = [e.id for e in catalog.entities]
    kinds: dict[tuple[str, str], list[str]] = {}
    for e in catalog.entities:
        kinds.setdefault((e.strategy, e.format), []).append(e.id)

    def masked(s: Column) -> Column:
        out = F.lit(None).cast("string")
        for (strategy, template), ids in kinds.items():
            for some in ([[i] for i in ids] if "{label}" in template else [ids]):
                out = F.when(s["entity_id"].isin(*some), mask_value(some[0], strategy, template, s["text"], s["n"], key)).otherwise(out)
        return out

    strategy = lambda s: F.element_at(F.create_map(*[x for e in catalog.entities for x in (F.lit(e.id), F.lit(e.strategy))]), s["entity_id"])
    own = F.filter(spans, lambda s: s["entity_id"].isin(*known)) if known else F.filter(spans, lambda s: F.lit(False))
    if not known:
        return F.transform(own, lambda s: F.struct(s["text"].alias("original"), s["text"].alias("masked"), s["entity_id"].alias("entity_id"), F.lit("redact").alias("strategy"), s["start"].alias("start"), s["end"].alias("end")))
    return F.transform(own, lambda s: F.struct(s["text"].alias("original"), masked(s).alias("masked"), s["entity_id"].alias("entity_id"), strategy(s).alias("strategy"), s["start"].alias("start"), s["end"].alias("end")))


def splice(gaps: Column, masked: Column, escape: Callable[[Column], Column] = lambda m: m) -> Column:
    """The text of ``gaps`` with the masked spans between them."""
    return F.concat(F.array_join(F.transform(masked, lambda m, i: F.concat(F.get(gaps, i), escape(m["masked"]))), ""), F.get(gaps, F.size(masked)))


def _put(df: DataFrame, catalog: Catalog, key: str | None, escape: Callable[[Column], Column] = lambda m: m) -> DataFrame:
    """Adds masked_text and masked_spans from ``_placed``, which is dropped."""
    masked = df.withColumn("_masked", mask_spans_column(_with_numbers(F.col("_placed")), catalog, key))
    # descending by start, as the replacement goes from right to left
    return masked.withColumns({"masked_text": splice(F.col("_placed.gaps"), F.col("_masked"), escape), "masked_spans": F.reverse("_masked")}).drop("_placed", "_masked")


def mask_spans(df: DataFrame, catalog: Catalog, key: str | None = None, text: str = "text_clean", spans: str = "spans") -> DataFrame:
    """Adds masked_text and masked_spans for disjoint ``spans`` of ``text``."""
    known = frozenset(e.id for e in catalog.entities)

    @once
    @F.pandas_udf(f"struct<{PLACED}>")
    def placed(texts: pd.Series, rows: pd.Series) -> pd.DataFrame:
        made = [place(t or "", list(r) if r is not None else [], known) for t, r in zip(texts, rows, strict=True)]
        return pd.DataFrame(made, columns=["spans", "n", "gaps"])

    return _put(df.withColumn("_placed", placed(F.col(text), F.col(spans))), catalog, key)


def stats(counts: Column, merged: Column, language: Column) -> Column:
    """Counts of spans by source (pattern, ner, llm), of those that are left, and the language."""
    return F.struct(*[counts[k].alias(f"spans_{name}") for k, name in enumerate(("pattern", "ner", "llm"))], F.size(merged).alias("spans_total"), language.alias("language"))


class Resolver:
    """Merge, trim, number and part the spans of one document: what stands between detection and masks, in one linear pass."""

    def __init__(self, catalog: Catalog) -> None:
        self.priority = {e.id: e.priority for e in catalog.entities}
        self.known = frozenset(self.priority)
        self.no_multiline = catalog.no_multiline

    def __call__(self, text: str, spans: list[dict]) -> tuple:
        merged = trim_lines(fold(spans, self.priority), self.no_multiline)
        return (*place(text, merged, self.known), [sum(s["source"] == source for s in spans) for source in ("pattern", "ner", "llm")])


_RESOLVED = f"struct<{PLACED},counts:array<int>"
_PLACED_TYPES = (pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), *[pa.string()] * 4)


def _finished(df: DataFrame, catalog: Catalog, options: MaskOptions) -> DataFrame:
    out = df.withColumn("detected_spans", F.col("_placed.spans")).withColumn("stats", stats(F.col("_placed.counts"), F.col("detected_spans"), F.col("language")))
    return _put(out, catalog, options.key)


def finish(df: DataFrame, catalog: Catalog, options: MaskOptions) -> DataFrame:
    """Merge, trim, mask and count: the steps behind detection. ``df`` has text_clean, language and spans."""
    resolver = Resolver(catalog)

    @once
    @F.pandas_udf(_RESOLVED + ">")
    def resolve(texts: pd.Series, rows: pd.Series) -> pd.DataFrame:
        made = [resolver(t or "", list(r) if r is not None else []) for t, r in zip(texts, rows, strict=True)]
        return pd.DataFrame(made, columns=["spans", "n", "gaps", "counts"])

    return _finished(df.withColumn("_placed", resolve("text_clean", "spans")), catalog, options).drop("spans")


def mask_documents(df: DataFrame, catalog: Catalog, options: MaskOptions = MaskOptions()) -> DataFrame:
    """Documents with personal data masked: masked_text, detected_spans, masked_spans, stats.

    Everything stays in the document's row: no shuffle, and the same call serves batch
    and streaming. One helper cleans, guesses the language, scans, merges, trims and numbers,
    so a text goes to Python once; its time is linear in the text and its spans. Rows that
    :func:`guard` rejects are left out; :func:`rejects` has them. layer_error names what
    went wrong in a row's scan, by rules or model; such a row has no spans and a null masked_text.
    """
    good = guard(df, options.text, options.max_chars).where("reject_reason IS NULL").drop("reject_reason")
    resolver, configured = Resolver(catalog), options.language
    guess = options.languages.guess if options.languages else guess_language

    @once
    @F.arrow_udf(_RESOLVED + ",language:string,error:string,text_clean:string,format:string>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rules = Rules(catalog, options.tagger)

        def scanned(raw: list[str]) -> pa.Array:
            made = list(map(clean_text, raw))
            texts = [t for t, _ in made]
            modelled = score_texts(texts, catalog, options.scorer, options.threshold, *MODEL_CHUNKS) if options.scorer else [([], None)] * len(texts)
            rows = []
            for (t, kind), (more, failed) in zip(made, modelled, strict=True):
                found, error = scan_safely(rules, t)
                error = error or (type(failed).__name__ if failed else None)
                rows.append((*resolver(t, [] if error else found + more), guess(t) if configured == "auto" else configured, error, t, kind))
            spans, *others = zip(*rows, strict=True) if rows else [()] * 8
            return pa.StructArray.from_arrays([span_arrays(spans), *map(pa.array, others, _PLACED_TYPES)], names=["spans", "n", "gaps", "counts", "language", "error", "text_clean", "format"])

        for batch in batches:
            raw = [t or "" for t in batch.to_pylist()]
            # spans as dictionaries are far larger than in Arrow, so only those of some texts are held at once
            yield pa.concat_arrays([scanned(raw[a:b]) for a, b in in_parts(raw, SCANNED)] or [scanned([])])

    ready = good.withColumns({"original_length": F.length(options.text), "_placed": scan(F.col(options.text))})
    ready = ready.withColumns({"format": F.col("_placed.format"), "text_clean": F.col("_placed.text_clean"), "language": F.col("_placed.language"), "layer_error": F.col("_placed.error")})
    out = _finished(ready, catalog, options).withColumn("masked_text", F.when(F.col("layer_error").isNull(), F.col("masked_text")))
    return out if options.keep_original else out.drop(options.text)


def _quoted(text: str) -> str:
    """``text`` as it stands within a JSON string; lone surrogates as escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", json.dumps(text, ensure_ascii=False)[1:-1])


def place_in_json(text: str, find: Callable[[str], list[dict]], known: frozenset[str]) -> tuple[list[dict], list[int], list[str]] | None:
    """As :func:`place` for the string leaves of a JSON text; None where it isn't JSON.

    ``find`` gives the disjoint spans of a leaf. Spans have the places of their values in
    their leaf's own text; values are numbered over the whole text. The pieces around them
    are the text as it stands: only a leaf that holds a span is written anew, so the order
    of keys, numbers, white space and the escapes of all other strings stay.
    """
    leaves = json_strings(text, paths=False)
    if leaves is None:
        return None
    spans, gaps, held, upto = [], [], [], 0
    for _, begin, end in leaves:
        value = json.loads(text[begin:end])
        if len(value) < LEAST_LEAF:
            continue
        own = sorted(find(re.sub("[\ud800-\udfff]", "\ufffd", value)), key=lambda s: s["start"])
        masked = [s for s in own if s["entity_id"] in known]
        spans += own
        if not masked:
            continue
        held.append(text[upto : begin + 1])
        at = 0
        for s in masked:
            gaps.append("".join(held) + _quoted(value[at : s["start"]]))
            held, at = [], s["end"]
        held.append(_quoted(value[at:]))
        upto = end - 1
    return spans, number(spans), [*gaps, "".join(held) + text[upto:]]


def mask_json(df: DataFrame, catalog: Catalog, options: MaskOptions = MaskOptions()) -> DataFrame:
    """Adds masked_text (``options.text`` with its string leaves masked in place), detected_spans and masked_spans to rows of JSON texts.

    Texts that aren't JSON have a null masked_text and no spans, null texts too: mask those
    as documents. Depth and length of a text are bounded only by memory.
    """
    resolver = Resolver(catalog)

    @once
    @F.pandas_udf(f"struct<ok:boolean,{PLACED}>")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rules = Rules(catalog, options.tagger)
        find = lambda value: trim_lines(fold(scan_safely(rules, value)[0], resolver.priority), resolver.no_multiline)
        for texts in batches:
            made = [None if t is None else place_in_json(t, find, resolver.known) for t in texts]
            yield pd.DataFrame([(False, [], [], [""]) if m is None else (True, *m) for m in made], columns=["ok", "spans", "n", "gaps"])

    ready = df.withColumn("_placed", placed(F.col(options.text))).withColumns({"detected_spans": F.col("_placed.spans"), "_ok": F.col("_placed.ok")})
    return _put(ready, catalog, options.key, escape=json_escaped).withColumn("masked_text", F.when(F.col("_ok"), F.col("masked_text"))).drop("_ok")


def json_escaped(value: Column) -> Column:
    """A string as it stands within a JSON string."""
    whole = F.to_json(F.array(value))
    return F.substring(whole, F.lit(3), F.length(whole) - 4)


def rejects(df: DataFrame, text: str = "text", max_chars: int = MAX_CHARS) -> DataFrame:
    """The rows that :func:`mask_documents` leaves out, with the reason."""
    return guard(df, text, max_chars).where("reject_reason IS NOT NULL")


def mask_with_model(df: DataFrame, catalog: Catalog, scorer: Scorer, options: MaskOptions = MaskOptions(), threshold: float = 0.4) -> DataFrame:
    """:func:`mask_documents` with a model's spans beside those of the rules, found in the same helper: no join, whatever the rows' ids."""
    return mask_documents(df, catalog, replace(options, scorer=scorer, threshold=threshold))


def mask_distinct(df: DataFrame, catalog: Catalog, options: MaskOptions = MaskOptions(), key: str = "doc_id") -> DataFrame:
    """As :func:`mask_documents`, each different text masked once; worth its two shuffles where many texts are copies."""
    hashed = df.withColumn("_hash", F.sha2(F.col(options.text), 256))
    once = mask_documents(hashed.select("_hash", options.text).dropDuplicates(["_hash"]), catalog, options)
    return hashed.drop(options.text).join(once, "_hash").drop("_hash")


def number_table(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """:func:`number_spans` for a table with one span a row."""
    first = F.min("start").over(Window.partitionBy(key, "entity_id", "text"))
    return spans.withColumn("_first", first).withColumn("n", F.dense_rank().over(Window.partitionBy(key, "entity_id").orderBy("_first"))).drop("_first")


def span_detail(df: DataFrame, digits: int = 4, missing: str | None = None) -> DataFrame:
    """One row a detected span: its mask and strategy, or its own text (or ``missing``) and unknown where it has none.

    A helper looks masks up by entity and original, so a document's cost is linear in its spans.
    """
    fallback = F.lit(missing).cast("string") if missing is not None else F.col("s.text")

    @once
    @F.pandas_udf("array<struct<masked:string,strategy:string>>")
    def found(spans: pd.Series, masked: pd.Series) -> pd.Series:
        out = []
        for own, done in zip(spans, masked, strict=True):
            by: dict[tuple[str, str], dict] = {}
            for m in [] if done is None else done:
                by.setdefault((m["entity_id"], m["original"]), {"masked": m["masked"], "strategy": m["strategy"]})
            out.append([by.get((s["entity_id"], s["text"])) for s in ([] if own is None else own)])
        return pd.Series(out, dtype=object)

    both = df.select("doc_id", F.explode(F.arrays_zip(F.col("detected_spans").alias("s"), found("detected_spans", "masked_spans").alias("m"))).alias("x")).select("doc_id", "x.*")
    return both.select(
        "doc_id", "s.entity_id", "s.display_name", F.col("s.text").alias("original"), F.coalesce("m.masked", fallback).alias("masked"), F.coalesce("m.strategy", F.lit("unknown")).alias("strategy"), F.round("s.confidence", digits).alias("confidence"), "s.source", "s.start", "s.end"
    )

"""Detection: rules over the text, values with checksums, models over chunks, reviewed findings.

Spans live in an array in the document's row, so a scan needs no shuffle and runs in
batch and streaming alike. Offsets are code points of the text that was scanned.
"""

from __future__ import annotations

import ipaddress
import itertools
import json
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import NEEDED, Catalog, builtin_entities
from ..functions.text import chunk_at_blanks, chunk_at_lines


def once(udf: Callable) -> Callable:
    """A helper that runs once a row: the filters that Spark makes of an explode would repeat its call, below a shuffle even, and scan each text twice."""
    return udf.asNondeterministic()


SPAN = "struct<text:string,start:int,end:int,entity_id:string,display_name:string,confidence:double,source:string,seq:int>"
SPANS = f"array<{SPAN}>"
_SPAN_FIELDS = (("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("entity_id", pa.string()), ("display_name", pa.string()), ("confidence", pa.float64()), ("source", pa.string()), ("seq", pa.int32()))
#: Lowest score of a recogniser's finding.
MIN_SCORE = 0.6


def span_arrays(rows: list[list[dict] | None]) -> pa.ListArray:
    """Spans by row as Arrow has them, made field by field: a table of rows of dictionaries is slow to convert."""
    flat = [s for own in rows for s in own or ()]
    spans = pa.StructArray.from_arrays([pa.array([s[name] for s in flat], kind) for name, kind in _SPAN_FIELDS], names=[name for name, _ in _SPAN_FIELDS])
    ends = list(itertools.accumulate((len(own or ()) for own in rows), initial=0))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans, mask=pa.array([own is None for own in rows], pa.bool_()))


#: Takes texts, labels and a threshold; gives (start, end, label, score) of what it finds in each text.
Scorer = Callable[[list[str], list[str], float], list[list[tuple[int, int, str, float]]]]


def luhn(number: str) -> bool:
    """The check digit of card numbers."""
    digits = [int(c) for c in number if c.isdigit()]
    doubled = [d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
    return len(digits) > 1 and sum(doubled) % 10 == 0


def iban(number: str) -> bool:
    """The remainder of an IBAN by 97, letters as two digits, the first four characters last."""
    packed = re.sub(r"\s", "", number).upper()
    return 15 <= len(packed) <= 34 and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def _is_ip(text: str) -> bool:
    try:
        ipaddress.ip_address(text)
        return True
    except ValueError:
        return False


def _is_ssn(text: str) -> bool:
    area, group, serial = text[:3], text[4:6], text[7:]
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


#: Recogniser: expression, check of the value, score, words that raise it to 0.85 when they stand up to 40 characters before.
RECOGNIZERS: dict[str, tuple[re.Pattern, Callable[[str], bool] | None, float, str]] = {
    "EMAIL_ADDRESS": (re.compile(r"(?<![\w.+-])[\w.+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![\w-])"), None, 1.0, ""),
    "IP_ADDRESS": (re.compile(r"(?<![\w.:])(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7})(?![\w:]|\.\d)"), _is_ip, 0.95, ""),
    "CREDIT_CARD": (re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"), luhn, 1.0, ""),
    "IBAN_CODE": (re.compile(r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{1,4}){3,8}\b"), iban, 1.0, ""),
    "US_SSN": (re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), _is_ssn, 0.85, ""),
    "PHONE_NUMBER": (re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}(?![\w-])"), None, 0.75, ""),
    "US_BANK_NUMBER": (re.compile(r"(?<![\w-])\d{8,17}(?![\w-])"), None, 0.3, "account|acct|bank"),
    "US_PASSPORT": (re.compile(r"(?<![\w-])[A-Za-z]?\d{8,9}(?![\w-])"), None, 0.3, "passport"),
    "US_DRIVER_LICENSE": (re.compile(r"(?<![\w-])[A-Za-z]\d{6,12}(?![\w-])"), None, 0.3, "driver|licen[sc]e"),
}


#: What a text must hold for a recogniser to find anything in it; the others need a digit.
NEEDED_PART = {"EMAIL_ADDRESS": re.compile("@"), "IP_ADDRESS": re.compile(r"\d\.\d+\.\d|:[0-9A-Fa-f]{0,4}:")}
DIGIT = re.compile(r"\d")


def recognise(text: str, wanted: dict[str, str], min_score: float = MIN_SCORE) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, entity, score) of the values that the recognisers of ``wanted`` (recogniser to entity) find."""
    digits = DIGIT.search(text) is not None
    for name, entity in wanted.items():
        if name not in RECOGNIZERS:
            continue
        part = NEEDED_PART.get(name)
        if not (digits if part is None else part.search(text)):
            continue
        pattern, check, score, words = RECOGNIZERS[name]
        for m in pattern.finditer(text):
            if check is not None and not check(m[0]):
                continue
            near = bool(words) and re.search(words, text[max(0, m.start() - 40) : m.start()], re.I) is not None
            if (found := 0.85 if near else score) >= min_score:
                yield m.start(), m.end(), entity, found


class Rules:
    """The rules of a catalogue, compiled once a worker; a rule that doesn't compile is left out.

    ``tagger``, trained on labels PERSON and ORG, is the recogniser of these two.
    """

    def __init__(self, catalog: Catalog, tagger: Scorer | None = None) -> None:
        self.tagger = tagger
        self.names = {e.id: e.display_name for e in catalog.entities}
        self.recognizers = catalog.recognizers()
        own = {p for e in builtin_entities() for p in e.patterns}  # only of these is it known that a \d must match
        self.rules: list[tuple[str, re.Pattern, bool, tuple[str, ...]]] = []
        for e in catalog.entities:
            for p in e.patterns:
                try:
                    self.rules.append((e.id, re.compile(p, re.I | re.M), p in own and r"\d" in p and "|" not in p, NEEDED.get(p, ())))
                except re.error:
                    continue
        #: One pass over a text finds which of the words that rules need are in it.
        self.words = ahocorasick.Automaton()
        for w in {w for *_, needed in self.rules for w in needed}:
            self.words.add_word(w, w)
        if len(self.words):
            self.words.make_automaton()

    def scan(self, text: str | None) -> list[dict]:
        """Recognisers' findings, then rules' in catalogue order; group 1 is the span where a rule has one."""
        if not text:
            return []
        out = [self._span(text, a, b, entity, score) for a, b, entity, score in recognise(text, self.recognizers)]
        if self.tagger is not None:
            out += [self._span(text, a, b, self.recognizers[name], score) for a, b, name, score in self.tagger([text], list(self.recognizers), MIN_SCORE)[0] if name in self.recognizers]
        digits = DIGIT.search(text) is not None
        held = {w for _, w in self.words.iter(text.lower())} if len(self.words) else set()
        for entity, pattern, numeric, needed in self.rules:
            if numeric and not digits or needed and held.isdisjoint(needed):
                continue
            for m in pattern.finditer(text):
                a, b = m.span(1) if m.lastindex else m.span()
                if b > a:
                    out.append(self._span(text, a, b, entity, 1.0))
        for seq, span in enumerate(out):
            span["seq"] = seq
        return out

    def _span(self, text: str, start: int, end: int, entity: str, score: float) -> dict:
        return {"text": text[start:end], "start": start, "end": end, "entity_id": entity, "display_name": self.names[entity], "confidence": score, "source": "pattern"}


def scan_safely(rules: Rules, text: str | None) -> tuple[list[dict], str | None]:
    """The spans of a text and no error, or none and the error's name: one bad row must not lose the others."""
    try:
        return rules.scan(text), None
    except Exception as e:
        return [], type(e).__name__


def detect_rules(df: DataFrame, catalog: Catalog, text: str = "text_clean", out: str = "spans", tagger: Scorer | None = None) -> DataFrame:
    """Adds the spans of all rules and recognisers, and layer_error where a row's scan failed (it then has none)."""

    @once
    @F.pandas_udf(f"struct<spans:{SPANS},error:string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rules = Rules(catalog, tagger)
        for texts in batches:
            yield pd.DataFrame([scan_safely(rules, t) for t in texts], columns=["spans", "error"])

    return df.withColumn("_found", scan(F.col(text))).withColumns({out: F.col("_found.spans"), "layer_error": F.col("_found.error")}).drop("_found")


def rule_values(text: Column, pattern: str) -> Column:
    """The values of one rule without their places, as a built-in expression."""
    return F.regexp_extract_all(text, F.lit(f"(?imd){pattern}"), F.lit(1 if re.compile(pattern).groups else 0))


def gazetteer(phrases: dict[str, list[str]]) -> Scorer:
    """A scorer that finds the phrases of each label, whole words in any case, at a score of 0.9."""

    def score(texts: list[str], labels: list[str], threshold: float) -> list[list[tuple[int, int, str, float]]]:
        wanted = {p.lower(): label for label, all_phrases in phrases.items() if label in labels for p in all_phrases}
        if not wanted or threshold > 0.9:
            return [[] for _ in texts]
        pattern = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(wanted, key=len, reverse=True))) + r")\b", re.I)
        return [[(m.start(), m.end(), wanted[m[0].lower()], 0.9) for m in pattern.finditer(t)] for t in texts]

    return score


def score_safely(parts: list[str], scorer: Scorer, labels: list[str], threshold: float) -> list[list[tuple[int, int, str, float]]]:
    """What ``scorer`` finds in each of ``parts``; it must answer for each of them."""
    found = scorer(parts, labels, threshold)
    if len(found) != len(parts):
        raise ValueError(f"the model answered for {len(found)} of {len(parts)} chunks")
    return found


def score_texts(texts: list[str], catalog: Catalog, scorer: Scorer, threshold: float, size: int, overlap: int) -> list[tuple[list[dict], Exception | None]]:
    """The spans of a model in each text and no error, or none and the error where the model fails on one of its chunks: one bad text must not lose the others.

    Chunks are scored together, offsets put back; equal spans stand once with the best score, the first of equal ones.
    """
    labels, names = catalog.labels(), {e.id: e.display_name for e in catalog.entities}
    cut = [chunk_at_blanks(t or "", size, overlap) for t in texts]
    failed: dict[int, Exception] = {}
    try:
        found = score_safely([part for own in cut for _, part in own], scorer, list(labels), threshold)
    except Exception:  # which texts it fails on, one by one
        found = []
        for k, own in enumerate(cut):
            try:
                found += score_safely([part for _, part in own], scorer, list(labels), threshold)
            except Exception as e:
                failed[k] = e
                found += [[]] * len(own)
    out, at = [], 0
    for k, own in enumerate(cut):
        best: dict[tuple[int, int, str], dict] = {}
        for (offset, part), spans in zip(own, found[at : at + len(own)], strict=True):
            for a, b, name, score in spans:
                if name not in labels or score < threshold:
                    continue
                entity = labels[name]
                key = (a + offset, b + offset, entity)
                if key not in best or score > best[key]["confidence"]:
                    best[key] = {"text": part[a:b], "start": key[0], "end": key[1], "entity_id": entity, "display_name": names[entity], "confidence": float(score), "source": "ner"}
        at += len(own)
        out.append(([s | {"seq": k} for k, (_, s) in enumerate(sorted(best.items()))], failed.get(k)))
    return out


def score_chunks(df: DataFrame, catalog: Catalog, scorer: Scorer, threshold: float = 0.4, size: int = 1200, overlap: int = 100, text: str = "text_clean", out: str = "spans", error: str | None = None) -> DataFrame:
    """Adds the spans of a model, by place and entity: overlapping chunks of the text are scored and their spans merged.

    Everything stays in the row, whatever its id: no join and no shuffle. ``scorer`` takes
    texts, labels and a threshold and returns (start, end, label, score) a text. Spans of
    unknown labels are dropped; null and empty texts have none. A text that the model fails
    on ends the job; where ``error`` names a column, that has the error's name and such a
    text has null for its spans, the others theirs.
    """

    @once
    @F.arrow_udf(f"struct<spans:{SPANS},error:string>")
    def score(texts: pa.Array) -> pa.Array:
        rows = []
        for spans, e in score_texts(texts.to_pylist(), catalog, scorer, threshold, size, overlap):
            if e is not None and error is None:
                raise e
            rows.append((spans, None) if e is None else (None, type(e).__name__))
        return pa.StructArray.from_arrays([span_arrays([spans for spans, _ in rows]), pa.array([e for _, e in rows], pa.string())], names=["spans", "error"])

    found = df.withColumn("_found", score(F.col(text))).withColumn(out, F.col("_found.spans"))
    return (found if error is None else found.withColumn(error, F.col("_found.error"))).drop("_found")


#: Characters of a bucket of positions in joins of intervals.
BUCKET = 2048


def candidates_of_chunks(chunks_table: DataFrame, spans: DataFrame, key: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """Every chunk with the spans (exploded, as entity_id, text, start, end) that overlap it; chunks without any stay.

    Chunks and spans meet by key and bucket of positions, so the work is linear in the
    table, its spans' lengths and the result, and a long document is spread over tasks.
    A pair that shares several buckets counts in the first one that both reach. Null keys
    are a key like others; rows that share a key meet all spans of it.
    """
    reach = lambda first, end: F.explode(F.sequence(F.floor(first / bucket), F.floor(F.greatest(first, end - 1) / bucket)))
    begin, end = F.col("offset"), F.col("offset") + F.length("chunk")
    some = chunks_table.withColumns({"_begin": begin, "_end": end}).withColumn("_bucket", reach(F.col("_begin"), F.col("_end")))
    places = spans.select(F.col(key).alias("_key"), F.col("entity_id"), F.col("text"), F.col("start"), F.col("end")).withColumn("_at", reach(F.col("start"), F.col("end")))
    home = F.greatest(F.floor(F.col("_begin") / bucket), F.floor(F.col("start") / bucket))
    met = some.join(places, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_at"))).where((F.col("start") < F.col("_end")) & (F.col("end") > F.col("_begin")) & (F.col("_bucket") == home))
    named = ["entity_id", "text", "start", "end"]
    found = met.select(*chunks_table.columns, *named)
    had = found.select(F.col(key).alias("_k"), F.col("offset").alias("_o"), F.length("chunk").alias("_n")).distinct()
    lone = chunks_table.join(had, F.col(key).eqNullSafe(F.col("_k")) & (F.col("offset") == F.col("_o")) & (F.length("chunk") == F.col("_n")), "left_anti")
    return found.unionByName(lone, allowMissingColumns=True)


def totals_of_chunks(chunks_table: DataFrame, spans: DataFrame, value: Column, key: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """Every chunk with ``n``, how many spans (start, end; of at least one character) overlap it, and ``total``, the sum of ``value`` over them, without pairs.

    The spans that overlap a chunk are those that begin before its end, less those that end
    by its beginning: two differences of running sums. Spans and chunks are first added up
    by place, so a bucket of places is a bounded group whatever the number of rows, and the
    sums of whole buckets go ahead of it. The work is linear in spans and chunks, also where
    each chunk overlaps a share of all spans. Null keys are a key like others.
    """
    begin, end = F.col("offset").cast("long"), F.col("offset").cast("long") + F.length("chunk")
    zero = F.lit(0).cast("long")
    value = F.coalesce(value.cast("long"), zero)
    names = ("opened", "opened_total", "closed", "closed_total")
    event = lambda at, *sums: F.struct(at.cast("long").alias("_at"), *[x.alias(n) for n, x in zip(names, sums, strict=True)])
    one = F.lit(1).cast("long")
    ends = F.array(event(F.col("start"), one, value, zero, zero), event(F.col("end") - 1, zero, zero, one, value))
    events = spans.where("start < end").select(F.col(key).alias("_key"), F.explode(ends).alias("e")).select("_key", "e.*")
    intervals = chunks_table.select(F.col(key).alias("_key"), begin.alias("_begin"), end.alias("_end")).distinct()
    asked = intervals.select("_key", F.explode(F.array(event(F.col("_begin"), *[zero] * 4), event(F.col("_end"), *[zero] * 4))).alias("e")).select("_key", "e.*")
    places = events.unionByName(asked).groupBy("_key", "_at").agg(*[F.sum(n).alias(n) for n in names]).withColumn("_bucket", F.floor(F.col("_at") / bucket))
    before = lambda window: [F.coalesce(F.sum(n).over(window.rowsBetween(Window.unboundedPreceding, -1)), zero).alias(f"_{n}") for n in names]
    within = places.select("_key", "_bucket", "_at", *before(Window.partitionBy("_key", "_bucket").orderBy("_at")))
    whole = places.groupBy("_key", "_bucket").agg(*[F.sum(n).alias(n) for n in names])
    ahead = whole.select(F.col("_key").alias("_k"), F.col("_bucket").alias("_b"), *[x.alias(f"_whole_{n}") for n, x in zip(names, before(Window.partitionBy("_key").orderBy("_bucket")), strict=True)])
    sums = within.join(ahead, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_bucket") == F.col("_b"))).select("_key", "_at", *[(F.col(f"_{n}") + F.col(f"_whole_{n}")).alias(n) for n in names])
    at = lambda name, *kept: sums.select(F.col("_key").alias(f"_k_{name}"), F.col("_at").alias(f"_at_{name}"), *kept)
    met = intervals.join(at("end", "opened", "opened_total"), F.col("_key").eqNullSafe(F.col("_k_end")) & (F.col("_end") == F.col("_at_end")))
    met = met.join(at("begin", "closed", "closed_total"), F.col("_key").eqNullSafe(F.col("_k_begin")) & (F.col("_begin") == F.col("_at_begin")))
    found = met.select("_key", "_begin", "_end", (F.col("opened") - F.col("closed")).alias("n"), (F.col("opened_total") - F.col("closed_total")).alias("total"))
    return chunks_table.join(found, F.col(key).eqNullSafe(F.col("_key")) & (begin == F.col("_begin")) & (end == F.col("_end"))).drop("_key", "_begin", "_end")


def inside(parts: list[tuple[int, str]], spans: list[dict]) -> list[list[dict]]:
    """For each chunk (offset, text), by rising offsets, the spans that overlap it, by start; a sweep, linear in spans and result."""
    todo, at, active, out = sorted(spans, key=lambda s: (s["start"], s["seq"])), 0, [], []
    for offset, part in parts:
        while at < len(todo) and todo[at]["start"] < offset + len(part):
            active.append(todo[at])
            at += 1
        active = [s for s in active if s["end"] > offset]  # offsets rise, so what ends here is in no later chunk
        out.append([s for s in active if s["start"] < offset + len(part)])
    return out


def token_budget(n: Column, configured: int = 1024) -> Column:
    """Tokens for an answer about ``n`` candidates: 22 each and 150 more, between 256 and the limit."""
    return F.greatest(F.lit(256), F.least(22 * n + 150, F.lit(1536), F.lit(configured if configured > 0 else 1536))).cast("int")


PROMPT = ("Entities:\n", "\nText:\n", "\nCandidates (JSON):\n", "\nAnswer with a JSON list of objects with e (entity) and t (exact text).\n")


def build_review_prompts(df: DataFrame, catalog: Catalog, configured: int = 1024, size: int = 3500, overlap: int = 200, text: str = "text_clean", key: str = "doc_id", parts: tuple[str, str, str, str] = PROMPT) -> DataFrame:
    """key, chunk_idx, offset, prompt and max_tokens: one prompt a chunk, with the candidates among ``spans`` that overlap it.

    One helper cuts the text and deals its spans to the chunks, so the spans of a document
    don't travel with each of its chunks. The prompt is put together from fixed parts, so
    texts that look like placeholders change nothing. ``key`` goes with the answers; where
    ids are null or repeat, number the rows first (:func:`numbered_rows`).
    """
    entities = "\n".join(f"  {e.id} ({e.display_name})" for e in catalog.entities)

    @F.pandas_udf("array<struct<chunk_idx:int,offset:int,chunk:string,told:string,n:int>>")
    def cut(texts: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(texts, rows, strict=True):
            own = chunk_at_lines(t or "", size, overlap)
            told = inside(own, [] if spans is None else list(spans))
            out.append([{"chunk_idx": k, "offset": o, "chunk": c, "told": json.dumps([{"e": s["entity_id"], "t": s["text"]} for s in some], ensure_ascii=False, separators=(",", ":")), "n": len(some)} for k, ((o, c), some) in enumerate(zip(own, told, strict=True))])
        return pd.Series(out, dtype=object)

    each = df.select(key, F.explode(cut(F.col(text), F.col("spans"))).alias("c")).select(key, "c.*")
    prompt = F.concat(F.lit(parts[0] + entities + parts[1]), F.col("chunk"), F.lit(parts[2]), F.col("told"), F.lit(parts[3]))
    return each.select(key, "chunk_idx", "offset", prompt.alias("prompt"), token_budget(F.col("n"), configured).alias("max_tokens"))


def numbered_rows(df: DataFrame, path: str, name: str = "row_id") -> DataFrame:
    """``df`` with a number of each row's own, written to ``path`` and read again, so that answers that come later find their rows whatever their ids."""
    df.withColumn(name, F.monotonically_increasing_id()).write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def parse_response(raw: str | None) -> tuple[bool, list[dict]]:
    """Whether an answer could be read, and its objects; a list that was cut off is mended if that takes one cut."""
    text = (raw or "").strip()
    if not text:
        return True, []
    if text.startswith("```"):
        text = re.sub(r"^```[^\n]*\n?|\n?```\s*$", "", text)
    first = text.find("[")
    if first < 0:
        return False, []
    last = text.rfind("]")
    if last > first:
        tries = [text[first : last + 1]]
    else:
        open_list = text[first:].rstrip()
        tries = [open_list.rstrip(",") + "]", open_list[: open_list.rfind("}") + 1] + "]"]
    for t in tries:
        try:
            value = json.loads(t)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, list):
            return True, [x for x in value if isinstance(x, dict)]
    return False, []


_ITEM = T.StructType([T.StructField("entity_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType())])


@F.pandas_udf(T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("items", T.ArrayType(_ITEM))]))
def parsed_response(raw: pd.Series) -> pd.DataFrame:
    """An answer's detections under the names of the tables; the short names e and t go first."""
    rows = []
    for r in raw:
        ok, items = parse_response(r)
        found = []
        for x in items:
            score = x.get("confidence")
            found.append({"entity_id": str(x.get("e") or x.get("entity_id") or ""), "text": str(x.get("t") or x.get("text") or ""), "confidence": float(score) if isinstance(score, int | float) and not isinstance(score, bool) else None})
        rows.append((ok, found))
    return pd.DataFrame(rows, columns=["ok", "items"])


def looks_truncated(raw: Column) -> Column:
    """A list that begins and doesn't end."""
    at = F.locate("[", raw)
    return (at > 0) & (F.locate("]", F.substr(raw, at)) == 0)


#: Most tokens of an answer, whatever the attempt.
MOST_TOKENS = 1536


def retries(responses: DataFrame) -> DataFrame:
    """Answers that look cut off, with twice their budget, at most 1536."""
    return responses.where(looks_truncated(F.col("raw"))).withColumn("max_tokens", F.least(2 * F.col("max_tokens"), F.lit(MOST_TOKENS)))


def settle(ledger: DataFrame, key: str = "doc_id", most_attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """What a ledger of attempts says of each chunk: its answer so far, and which chunks to ask again.

    ``ledger`` has key, chunk_idx, attempt (from 1), call_ok, raw and max_tokens. The first
    result has, for each chunk, its latest good answer (call and parse succeeded, not cut
    off), else its latest one, as the columns of the ledger with ok. The second has the
    chunks whose latest attempt was cut off or failed and that have attempts left: the next
    attempt's number, with twice the budget after a cut. One aggregate, no join.
    """
    cut = F.coalesce(looks_truncated(F.col("raw")), F.lit(False))
    good = F.coalesce(F.col("call_ok") & parsed_response("raw")["ok"] & ~cut, F.lit(False))
    judged = ledger.withColumns({"_good": good, "_cut": cut})
    row = F.struct("attempt", "call_ok", "raw", "max_tokens", "_good", "_cut")
    each = judged.groupBy(key, "chunk_idx").agg(F.max_by(row, F.struct("_good", "attempt")).alias("b"), F.max_by(row, "attempt").alias("l"))
    settled = each.select(key, "chunk_idx", "b.attempt", "b.call_ok", "b.raw", "b.max_tokens", F.col("b._good").alias("ok"))
    doubled = F.when(F.col("l._cut"), F.least(2 * F.col("l.max_tokens"), F.lit(MOST_TOKENS))).otherwise(F.col("l.max_tokens"))
    again = each.where(~F.col("b._good") & (F.col("l.attempt") < most_attempts)).select(key, "chunk_idx", (F.col("l.attempt") + 1).alias("attempt"), doubled.cast("int").alias("max_tokens"))
    return settled, again


def review(prompts: DataFrame, ask: Callable[[DataFrame], DataFrame], path: str, key: str = "doc_id", most_attempts: int = 3) -> DataFrame:
    """The settled answers of ``prompts``: asked, and asked again with larger budgets until none is left to ask.

    ``ask`` takes prompts (with attempt and max_tokens) and gives key, chunk_idx, raw and
    call_ok for them. Each attempt's answers are written under ``path``, by attempt, so a
    job that stops goes on with the next attempt and asks nothing twice.
    """
    spark = prompts.sparkSession
    columns = (key, "chunk_idx", "attempt", "call_ok", "raw", "max_tokens")
    todo = prompts.withColumn("attempt", F.lit(1))
    ledger = None
    for k in range(1, most_attempts + 1):
        at = f"{path}/attempt={k}"
        if not _written(spark, at):
            asked = ask(todo).select(key, "chunk_idx", "call_ok", "raw")
            budget = todo.select(F.col(key).alias("_key"), F.col("chunk_idx").alias("_idx"), "attempt", "max_tokens")
            whole = asked.join(budget, F.col(key).eqNullSafe(F.col("_key")) & (F.col("chunk_idx") == F.col("_idx"))).select(*columns)
            whole.drop("attempt").write.mode("overwrite").parquet(at)
        ledger = spark.read.parquet(path).select(*columns).where(F.col("attempt") <= k)
        settled, again = settle(ledger, key, most_attempts)
        if not again.limit(1).count():
            return settled
        new = again.select(F.col(key).alias("_key"), F.col("chunk_idx").alias("_idx"), F.col("attempt"), F.col("max_tokens"))
        todo = prompts.drop("max_tokens").join(new, F.col(key).eqNullSafe(F.col("_key")) & (F.col("chunk_idx") == F.col("_idx"))).drop("_key", "_idx")
    return settle(ledger, key, most_attempts)[0]


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a job finished writing ``path``."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


REVIEWED = 0.93


def valid_detections(items: DataFrame, catalog_ids: DataFrame) -> DataFrame:
    """Detections (entity_id, text, confidence) with a text and a known entity (id of ``catalog_ids``); 0.93 where no confidence is given."""
    kept = items.where((F.col("entity_id") != "") & (F.col("text") != "")).withColumn("confidence", F.coalesce("confidence", F.lit(REVIEWED)))
    return kept.join(F.broadcast(catalog_ids.select(F.col("id").alias("entity_id"))), "entity_id", "left_semi")


def folded(text: str) -> str:
    """``text`` with each character in its folded case where that is one character, so that offsets stay as they are."""
    if text.isascii():
        return text.lower()
    return "".join(f if len(f := c.casefold()) == 1 else f if len(f := c.lower()) == 1 else c for c in text)


def _occurrences(text: str, values: list[str]) -> dict[str, list[tuple[int, int]]]:
    """All places of the values, overlapping ones too, by one automaton over the text."""
    machine = ahocorasick.Automaton()
    for v in values:
        machine.add_word(v, v)
    out: dict[str, list[tuple[int, int]]] = {}
    if len(machine):
        machine.make_automaton()
        for last, v in machine.iter(text):
            out.setdefault(v, []).append((last + 1 - len(v), last + 1))
    return out


def find_values(text: str, values: list[str]) -> dict[str, list[tuple[int, int]]]:
    """For each value every exact occurrence, overlapping ones too; where there is none, those in any case, one behind the other."""
    asked = [v for v in dict.fromkeys(values) if v]
    exact = _occurrences(text, asked)
    missing = [v for v in asked if v not in exact]
    if missing:
        loose = _occurrences(folded(text), [folded(v) for v in missing])
        for v in missing:
            upto = -1
            for a, b in loose.get(folded(v), ()):
                if a >= upto:
                    exact.setdefault(v, []).append((a, b))
                    upto = b
    return exact


def find_all(text: str, value: str) -> list[tuple[int, int]]:
    """:func:`find_values` of one value."""
    return find_values(text, [value]).get(value, [])


def locate(df: DataFrame, detections: DataFrame, catalog: Catalog, text: str = "text_clean", key: str = "doc_id") -> DataFrame:
    """``df`` with the spans (``llm_spans``) of the detections (key, entity_id, text, confidence) of each document.

    Detections are made distinct and gathered to one array a document before they meet
    the texts; one automaton a document then finds all its values. The first one of equal
    place and entity wins. Null keys are a key like others. ``key`` should name rows: rows
    that share one are searched for all values of it; :func:`numbered_rows` gives each its own.
    """
    names = {e.id: e.display_name for e in catalog.entities}
    one = detections.groupBy(key, "entity_id", "text").agg(F.max("confidence").alias("confidence"))
    lists = one.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("entity_id", "text", "confidence"))).alias("_asked"))

    @once
    @F.pandas_udf(SPANS)
    def place(texts: pd.Series, asked: pd.Series) -> pd.Series:
        out = []
        for t, items in zip(texts, asked, strict=True):
            seen, spans = set(), []
            items = list(items) if items is not None else []
            found = find_values(t or "", [x["text"] for x in items]) if items else {}
            for x in items:
                for a, b in found.get(x["text"], ()):
                    if (a, b, x["entity_id"]) not in seen:
                        seen.add((a, b, x["entity_id"]))
                        spans.append({"text": t[a:b], "start": a, "end": b, "entity_id": x["entity_id"], "display_name": names.get(x["entity_id"], x["entity_id"]), "confidence": x["confidence"], "source": "llm", "seq": len(spans)})
            out.append(spans)
        return pd.Series(out, dtype=object)

    return df.join(lists, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("llm_spans", place(F.col(text), F.col("_asked"))).drop("_asked", "_key")


def document_gate(chunk_results: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and ok: a document passes if any of its chunks (call_ok, parse_ok) does."""
    return chunk_results.groupBy(key).agg(F.bool_or(F.coalesce(F.col("call_ok") & F.col("parse_ok"), F.lit(False))).alias("ok"))


def ingest_responses(df: DataFrame, responses: DataFrame, catalog: Catalog, text: str = "text_clean", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Documents of ``df`` with ``llm_spans`` from the answers (key, chunk_idx, raw, call_ok), and the rejected ones.

    Documents with a blank text pass without an answer; others without one good answer are
    rejected. Answers find their documents by ``key``; where doc_ids are null or repeat it
    should be the number that :func:`numbered_rows` gave, or one document's answer would
    pass the others of its id.
    """
    parsed = responses.withColumn("p", parsed_response("raw"))
    gate = document_gate(parsed.select(key, "call_ok", F.col("p.ok").alias("parse_ok")), key).select(F.col(key).alias("_key"), "ok")
    items = parsed.where("call_ok AND p.ok").select(key, F.explode("p.items").alias("i")).select(key, "i.*")
    ids = df.sparkSession.createDataFrame([(e.id,) for e in catalog.entities], "id string")
    judged = df.join(gate, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key").withColumn("ok", F.coalesce("ok", F.lit(False)) | (F.trim(F.coalesce(F.col(text), F.lit(""))) == ""))
    rejects = judged.where(~F.col("ok")).select(key, F.lit("review_failed").alias("reject_reason"))
    return locate(judged.where("ok").drop("ok"), valid_detections(items, ids), catalog, text, key), rejects

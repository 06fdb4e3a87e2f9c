"""PII by bootstrapped contextual extraction.

Seeds are what four fixed expressions find (e-mail, IP, card, phone). Each place of a
seed yields lexical patterns: the two words before it, the two words behind it, and the
word on either side. Other runs of digit groups and other tokens that look like
identifiers are candidate instances with patterns of the same sorts. Patterns and values
make a graph, scored in rounds. The score of a pattern for a kind is the mean over all
different values that it draws in:

- a seed of the kind counts 1, a seed of another kind 0;
- a candidate counts ``SUPPORT`` once another pattern has had it accepted, else 0;
- a number of a card's length whose check digit is wrong counts -1 for cards until then.

A pattern of ``MIN_SEEDS`` such values and a score of ``MIN_SCORE`` or more is accepted,
and so are the candidates that it draws in; these lend support to their other patterns.
A pattern that isn't accepted has none of its own candidates accepted by itself, so its
evidence never comes from its own score. Scores only rise, and rounds go on until nothing
new is accepted. Accepted values are findings wherever they stand.

Texts are read once. What leaves that pass is small: the spans of the seeds and, for each
candidate, its place and the hashes of its value and patterns. Edges are made distinct
before they are shuffled; joins send the rows of a heavy pattern or value nowhere, so that one which
a third of all rows share is no single task's work. A round joins only what is new.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, meet, salted, spread, stored, with_keys

# The base expressions of the contract, made linear where they would rescan a run.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Digit groups joined by single blanks, dots or dashes and by brackets: the shapes of card, phone and address without their checks.
RUN = re.compile(r"(?<![\w@.-])[+(]?[0-9]++(?:(?:\)[\x20.-]?|[\x20.-]\(?)[0-9]++(?![\w@]))*+(?!\w|[@.-]\w)")
RUN_DIGITS = 7
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
KINDS = ("email", "ip", "card", "phone")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

TRIM = "\"'()[]{}<>,;:!?."
#: A pattern is accepted at this score, with this many different seeds and accepted values behind it.
MIN_SCORE, MIN_SEEDS = 0.8, 5
#: What an accepted candidate counts.
SUPPORT = 0.95
#: Digits of a card number.
CARD_DIGITS = range(16, 20)
#: More digits than any identifier of the four kinds has.
MOST_DIGITS = 19
LONG_GROUP = re.compile(r"(?<!\S)[0-9]{12,19}(?!\S)")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def find_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part and domain: each at sign takes the run before it."""
    out, upto, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > upto and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            upto = m.end()
        else:
            upto = at + 1
        at = text.find("@", max(upto, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", a, b) for a, b in find_emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def fails_check(value: str) -> bool:
    """Whether a value has the digits of a card number and a wrong check digit."""
    digits = re.sub(r"[\x20-]", "", value)
    return len(digits) in CARD_DIGITS and digits.isascii() and digits.isdigit() and not luhn(digits)


def patterns(text: str, spans: list[tuple[int, int]]) -> list[list[str]]:
    """The patterns of each place (start, end): words before, behind and around it, in lower case with digits as #.

    White space parts words; a word that is cut by the span counts with the part outside it.
    """
    words = [m.span() for m in re.finditer(r"\S+", text)] if spans else []
    begins, ends = [a for a, _ in words], [b for _, b in words]

    def plain(a: int, b: int) -> str:
        return re.sub(r"\S*\d\S*", "#", text[a:b].lower())

    out = []
    for start, end in spans:
        at, behind = bisect_left(begins, start), bisect_right(ends, end)
        left = [plain(a, min(b, start)) for a, b in words[max(0, at - 2) : at]]
        right = [plain(max(a, end), b) for a, b in words[behind : behind + 2]]
        own = []
        if left:
            own.append("< " + " ".join(left))
        if right:
            own.append("> " + " ".join(right))
        if left and right:
            own.append(f"| {left[-1]} _ {right[0]}")
        out.append(own)
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Runs of digit groups and tokens like identifiers that no base span touches.

    A run of more digits than any identifier has is parted at its long groups.
    """
    out, taken = [], sorted((a, b) for _, a, b in base)
    parts, upto = [], 0
    for a, b in taken:
        parts += [text[upto:a], "\0" * (b - max(a, upto))]
        upto = max(upto, b)
    rest = "".join(parts) + text[upto:]  # of the same length; base spans part the runs beside them
    for m in RUN.finditer(rest):
        pieces = [m.span()]
        if sum(c.isdigit() for c in m[0]) > MOST_DIGITS:
            pieces, at = [], m.start()
            for g in LONG_GROUP.finditer(m[0]):
                pieces += [(at, m.start() + g.start()), (m.start() + g.start(), m.start() + g.end())]
                at = m.start() + g.end()
            pieces.append((at, m.end()))
        for a, b in pieces:
            piece = rest[a:b]
            a, b = a + len(piece) - len(piece.lstrip(" .-")), b - len(piece) + len(piece.rstrip(" .-"))
            if sum(c.isdigit() for c in piece) >= RUN_DIGITS:
                out.append((a, b))
    taken = _disjoint(sorted(taken + out))
    ends = [b for _, b in taken]
    for m in TOKEN.finditer(text):
        raw = m[0].strip(TRIM)
        if len(raw) < 5 or (sum(c.isdigit() for c in raw) < 3 and "@" not in raw):
            continue
        a = m.start() + m[0].index(raw)
        b = a + len(raw)
        at = bisect_right(ends, a)  # the first span that ends behind the token's start
        if at == len(taken) or taken[at][0] >= b:
            out.append((a, b))
    return sorted(out)


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FOUND = "row long, doc_id long, base array<struct<kind:string,start:int,end:int>>, seeds array<struct<kind:string,value:long,patterns:array<long>>>, others array<struct<start:int,end:int,mail:boolean,failed:boolean,value:long,patterns:array<long>>>"


def _value(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _find(docs: DataFrame) -> DataFrame:
    def rows(batch: dict) -> dict:
        out: dict = {"row": batch["row"], "doc_id": batch["doc_id"], "base": [], "seeds": [], "others": []}
        for text in batch["text"]:
            text = text or ""
            base = base_spans(text)
            more = candidates(text, base)
            hashed = [list(map(_value, p)) for p in patterns(text, [(a, b) for _, a, b in base] + more)]
            out["base"].append([{"kind": k, "start": a, "end": b} for k, a, b in base])
            out["seeds"].append([{"kind": k, "value": _value(text[a:b]), "patterns": p} for (k, a, b), p in zip(base, hashed, strict=False)])
            out["others"].append([{"start": a, "end": b, "mail": "@" in text[a:b], "failed": fails_check(text[a:b]), "value": _value(text[a:b]), "patterns": p} for (a, b), p in zip(more, hashed[len(base) :], strict=True)])
        return out

    return map_rows(docs, rows, FOUND)


def score_values(seeds: DataFrame, others: DataFrame) -> DataFrame:
    """kind, value, score: the candidate values that are accepted, each for its best kind.

    ``seeds`` has kind, pattern, value; ``others`` has pattern, value, mail, failed. A value
    counts once a pattern, however often it occurs. A value with an at sign can be an e-mail
    only, and no other value can. A value that is a seed anywhere is a seed of that kind,
    never a candidate. The score of a value is that of its best pattern when it was
    accepted; of several kinds the best is taken, on ties the first by name.
    """
    seeds, others = stored(seeds.distinct()), stored(others.distinct())
    # values that are seeds elsewhere are few, as base spans part the runs beside them
    both = others.select("value").distinct().join(seeds.select("value").distinct(), "value", "left_semi")
    edges = stored(salted(others, "pattern").join(spread(both), ["value", "salt"], "left_anti").select("pattern", "value", "mail", "failed"))
    total = edges.count()
    drawn = seeds.select("pattern", "value").distinct().select("pattern", F.lit(0).alias("edge"), F.lit(0).alias("bad")).unionByName(edges.select("pattern", F.lit(1), F.col("failed").cast("int")).toDF("pattern", "edge", "bad"))
    drawn = drawn.groupBy("pattern").agg(F.count("*").alias("n_all"), F.sum("edge").alias("n"), F.sum("bad").alias("n_failed"))
    first = seeds.groupBy("kind", "pattern").agg(F.count("*").alias("held"), F.count("*").cast("double").alias("weight"))
    sums = stored(first)  # kind, pattern, held and weight: what counts for a pattern so far
    drawn = stored(drawn)
    spans_of = stored(edges.groupBy("value").agg(F.count("*").alias("n")))
    accepted = values = None
    while True:
        lost = F.when(F.col("kind") == "card", F.col("n_failed")).otherwise(F.lit(0))
        score = (F.col("weight") - lost) / F.col("n_all")
        good = sums.where(F.col("held") >= MIN_SEEDS).join(drawn, "pattern").select("kind", "pattern", score.alias("score"), "n").where(F.col("score") >= MIN_SCORE)
        new = stored(good if accepted is None else good.join(accepted, ["kind", "pattern"], "left_anti"))
        hits = meet(edges.select("pattern", "value", "mail", "failed"), new, "pattern", total).where((F.col("kind") == "email") == F.col("mail"))
        found = hits.groupBy("kind", "value").agg(F.max("score").alias("score"), F.first("failed").alias("failed"))
        fresh = stored(found if values is None else found.join(values.select("kind", "value"), ["kind", "value"], "left_anti"))
        if not fresh.limit(1).count():
            break
        accepted = new.select("kind", "pattern") if accepted is None else accepted.unionByName(new.select("kind", "pattern"))
        values = fresh if values is None else values.unionByName(fresh)
        # of each accepted value the other patterns gain; those that are accepted already need no more
        gained = meet(edges.select("pattern", "value"), fresh.join(spans_of, "value"), "value", total)
        more = F.lit(SUPPORT) + F.when((F.col("kind") == "card") & F.col("failed"), 1.0).otherwise(0.0)
        gain = gained.groupBy("kind", "pattern").agg(F.count("*").alias("held"), F.sum(more).alias("weight"))
        sums = stored(sums.unionByName(gain).groupBy("kind", "pattern").agg(F.sum("held").alias("held"), F.round(F.sum("weight"), 6).alias("weight")))
    if values is None:
        return fresh.select("kind", "value", "score")
    return values.groupBy("value").agg(F.min(F.struct((-F.col("score")).alias("s"), "kind")).alias("m")).select("m.kind", "value", (-F.col("m.s")).alias("score"))


def _found(docs: DataFrame) -> DataFrame:
    """row, doc_id, base and added for each row of ``docs`` (row, doc_id, text)."""
    found = stored(_find(docs))
    seeds = found.select(F.explode("seeds").alias("s")).select("s.kind", "s.value", F.explode("s.patterns").alias("pattern"))
    places = found.select("row", F.explode("others").alias("o")).select("row", "o.*")
    good = score_values(seeds, places.select(F.explode("patterns").alias("pattern"), "value", "mail", "failed"))
    counted = stored(places.select("row", "start", "end", "value").join(good.select("kind", "value"), "value", "left_semi").groupBy("value").agg(F.count("*").alias("n")))
    hits = meet(places.select("row", "start", "end", "value"), good.select("kind", "value").join(counted, "value"), "value", max(1, counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    added = hits.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return found.select("row", "doc_id", "base").join(added, "row", "left").withColumn("added", F.coalesce("added", empty))


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` and ``added`` spans (arrays of kind, start, end in code points) of every whole text.

    A null or empty text has none. Every row is judged by itself, whatever its doc_id: null
    and repeated ids keep all their rows, and rows of equal text have equal spans. An empty
    table gives an empty one; further columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _found(rows).select("doc_id", "base", "added")


def _listed(spans: F.Column) -> F.Column:
    order = F.transform(spans, lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest_pii(docs: DataFrame) -> DataFrame:
    """The counts and the digest of the base spans, all spans as text, and how many spans there are and were added."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_pii(docs).select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )


def masked_text(text: str, spans: list[dict]) -> str:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first by start, then end, kind."""
    out, upto = [], 0
    for a, b, kind in sorted((s["start"], s["end"], s["kind"]) for s in spans):
        if a >= upto:
            out += [text[upto:a], f"[{kind.upper()}]"]
        upto = max(upto, b)
    return "".join(out) + text[upto:]


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every finding in its text replaced by its kind in brackets; n_chars, where it is a column, follows the new text.

    Spans meet their row by a number of the row's own, so rows of null and repeated doc_ids
    are masked by their own spans. Null texts stay null; all columns are kept as they are.
    """
    keyed, _ = with_keys(docs)
    spans = _found(keyed.select(F.col("_key").alias("row"), F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text")))
    touched = spans.select(F.col("row").alias("_key"), F.concat("base", "added").alias("spans")).where(F.size("spans") > 0)

    @F.pandas_udf("string")
    def mask(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else masked_text(t, list(s)) for t, s in zip(texts, found, strict=True)], dtype=object)

    own = F.col("doc.text").cast("string")
    new = keyed.join(touched, "_key", "left").select("doc", F.when(F.col("spans").isNull(), own).otherwise(mask(own, "spans")).alias("masked"))
    put = {"text": F.col("masked"), "n_chars": F.length("masked").cast("long")}
    return new.select(*[(put[c] if c in put else F.col("doc")[c]).alias(c) for c in docs.columns])

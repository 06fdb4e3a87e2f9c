"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of two lexicons (whole words and word beginnings, learned
from labelled rows by smoothed log-odds), how near lexicon words stand to words of the
second person, shares of capitals, exclamation and question marks, digits and symbols
inside words (obfuscation), repeated words, and length. The features of every row come
from one pass over its whole text; the model is Spark ML's.

Everything is cross-fitted: the labelled rows are dealt into ``FOLDS`` folds by a hash of
the id, a row's features come from lexicons of the other folds, and the raw scores that
the calibration learns from come from trees that have not seen the row's fold. The
lexicons and trees that score all documents learn from all of the sample, which takes at
most ``SAMPLE`` rows, in the order of that hash: its documented bound. Nothing here is
drawn at random, so equal input gives equal scores; of labels that contradict each other
for one doc_id the toxic one counts, of several texts with one doc_id the first.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, stored

#: Labelled rows that are learned from at most.
SAMPLE = 12_000
FOLDS = 3
#: Terms of each lexicon at most, and how many positive rows must hold a term.
TERMS, SUPPORT = 400, 4
LIMIT = 0.7

# Words of the second person in English, German, French and Spanish.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta vous votre usted ustedes tus vosotros".split())
FEATURES = ("words", "beginnings", "weight", "near_you", "capitals", "shouts", "asks", "symbols", "obfuscated", "repeats", "log_words")

_EDGE = "\"'()[]{}<>,;:!?.*#$%&|-_"
_LEET = str.maketrans("013457@$!", "oieastasi")


def tokens(text: str) -> list[str]:
    return [w for raw in text.lower().split() if (w := raw.strip(_EDGE))]


def plain(word: str) -> str:
    """A word with look-alike digits and signs as letters, and letter runs of three or more as one."""
    out = word.translate(_LEET) if not word.isalpha() else word
    return re.sub(r"(.)\1{2,}", r"\1", re.sub(r"[^\w]|_", "", out))


def features(text: str, words: dict[str, float], beginnings: dict[str, float]) -> list[float]:
    all_words = tokens(text)
    n = max(1, len(all_words))
    hits, weight, partly, hidden = [], 0.0, 0, 0
    for k, raw in enumerate(all_words):
        if (found := words.get(raw)) is None and not raw.isalpha():
            found = words.get(plain(raw))
            hidden += found is not None
        if found is not None:
            hits.append(k)
            weight += found
        if (found := beginnings.get(raw[:4])) is not None:
            partly += 1
            weight += found
    you = [k for k, w in enumerate(all_words) if w in YOU]
    near = 0
    j = 0
    for k in hits:
        while j < len(you) and you[j] < k - 5:
            j += 1
        near += j < len(you) and you[j] <= k + 5
    letters = max(1, len(text))
    odd = sum(any(c.isdigit() for c in w) and any(c.isalpha() for c in w) for w in all_words if not w.isalpha())
    symbols = sum(map(text.count, "#*$%&|<>"))
    repeats = sum(a == b for a, b in zip(all_words, all_words[1:], strict=False))
    return [len(hits) / n, partly / n, weight / n, near / n, sum(map(str.isupper, text)) / letters, text.count("!") / letters, text.count("?") / letters, symbols / letters, (hidden + odd) / n, repeats / n, math.log1p(len(all_words))]


Lexicons = tuple[dict[str, float], dict[str, float]]


def _terms(rows: DataFrame) -> DataFrame:
    """fold, term, t (toxic rows with the term) and n (all rows with it): words (``w ``), and beginnings of four letters (``b ``)."""

    def terms(batch: dict) -> dict:
        found = [set(tokens(t or "")) for t in batch["text"]]
        return {"fold": batch["fold"], "toxic": batch["toxic"], "terms": [[f"w {w}" for w in f] + [f"b {b}" for b in {w[:4] for w in f if len(w) >= 4}] for f in found]}

    listed = map_rows(rows.select("fold", "toxic", "text"), terms, "fold int, toxic int, terms array<string>")
    return listed.select("fold", "toxic", F.explode("terms").alias("term")).groupBy("fold", "term").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))


def _lexicons(counted: DataFrame, pos: int, neg: int) -> Lexicons:
    """Terms of toxic rows with their log-odds, from counts by :func:`_terms` of ``pos`` toxic and ``neg`` other rows; bounded by ``TERMS`` each."""
    odds = F.log((F.col("t") + 0.5) / (pos + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / (neg + 1.0))
    summed = counted.groupBy("term").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    scored = summed.where(F.col("t") >= SUPPORT).select("term", odds.alias("odds"), "t").where("odds > 3")
    place = F.row_number().over(Window.partitionBy(F.substring("term", 1, 1)).orderBy(F.desc(F.col("odds") * F.log1p("t")), "term"))
    out: dict[str, dict[str, float]] = {"w": {}, "b": {}}
    for r in scored.withColumn("place", place).where(F.col("place") <= TERMS).collect():
        out[r.term[0]][r.term[2:]] = float(r.odds)
    return out["w"], out["b"]


def _at_once(spark: SparkSession, jobs: list[Callable]) -> list:
    """The results of ``jobs``, which run side by side: each is a row of small Spark jobs that leave most cores idle."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(j)) for j in jobs]]


def _featured(docs: DataFrame, lexicons: list[Lexicons], keep: str = "") -> DataFrame:
    """The ``keep`` columns as DDL and one double for each feature; a column ``fold`` says which of the lexicons a row takes."""
    kept = [c.split()[0] for c in keep.split(",")]

    def rows(batch: dict) -> dict:
        made = [features(t or "", *lexicons[k]) for t, k in zip(batch["text"], batch["fold"], strict=True)]
        return {k: batch[k] for k in kept} | {f: [m[i] for m in made] for i, f in enumerate(FEATURES)}

    ddl = keep + ", " + ", ".join(f"{f} double" for f in FEATURES)
    return map_rows(docs.select(*dict.fromkeys([*kept, "fold", "text"])), rows, ddl)


def _vector(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)


def _trees(rows: DataFrame) -> GBTClassificationModel:
    trees = GBTClassifier(labelCol="toxic", maxIter=15, maxDepth=4, stepSize=0.3, seed=7, minInstancesPerNode=5)
    return trees.fit(rows.coalesce(2).sortWithinPartitions("doc_id"))


def held_out(doc_id: F.Column) -> F.Column:
    """The rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 at ``LIMIT`` or more) for every row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and toxic; held-out rows, null labels and labels of null doc_ids
    are not used. Null and empty texts get a score as well, and so do rows of null doc_ids.
    Where the labels show one class only, that class is the score of all, 0 where there are
    none. Repeated rows and further columns need no care; an empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = docs.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id"), F.lit("toxicity"))
    chosen = usable.orderBy(order, "doc_id").limit(sample).withColumn("fold", F.pmod(order, F.lit(FOLDS)).cast("int"))
    # as many ids as the sample at most
    labelled = stored(docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "fold").agg(F.min("text").alias("text")))
    known = {(r.fold, r.toxic): r.n for r in labelled.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    both = [sum(n for (_, y), n in known.items() if y == label) for label in (0, 1)]
    if not all(both):
        constant = 1.0 if both[1] else 0.0
        return own.select("doc_id", "held_out", F.lit(constant).alias("score"), F.lit(int(constant >= LIMIT)).alias("predicted"))
    # a fold is scored by the others if those have rows of both classes; else, with few labels, by all
    sides = [[sum(n for (j, y), n in known.items() if y == label and j != k) for label in (0, 1)] for k in range(FOLDS)]
    others = [F.col("fold") != k if all(sides[k]) else F.lit(True) for k in range(FOLDS)] + [F.lit(True)]
    sizes = [s if all(s) else both for s in sides] + [both]
    counted = stored(_terms(labelled))
    lexicons = _at_once(docs.sparkSession, [partial(_lexicons, counted.where(o), pos, neg) for o, (neg, pos) in zip(others, sizes, strict=True)])
    ready = _vector(stored(_featured(labelled, lexicons, "doc_id long, toxic int, fold int")))
    chance = vector_to_array("probability")[1]
    *parts, trees = _at_once(docs.sparkSession, [partial(_trees, ready.where(o)) for o in others])
    raw = reduce(DataFrame.unionByName, (t.transform(ready.where(F.col("fold") == k)).select("doc_id", "toxic", chance.alias("raw")) for k, t in enumerate(parts)))
    curve = IsotonicRegression(labelCol="toxic", featuresCol="raw", predictionCol="score").fit(raw.coalesce(2))
    every = _vector(_featured(own.withColumn("fold", F.lit(FOLDS)), lexicons, "doc_id long, held_out boolean"))
    scored = curve.transform(trees.transform(every).select("doc_id", "held_out", chance.alias("raw")))
    score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= LIMIT).cast("int").alias("predicted"))

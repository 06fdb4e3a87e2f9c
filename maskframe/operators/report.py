"""Counts, layer comparisons and accuracy over masked documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_spans(df: DataFrame, spans: str = "detected_spans", key: str = "doc_id") -> DataFrame:
    """One row a span."""
    return df.select(key, F.explode(spans).alias("s")).select(key, "s.*")


def entity_counts(spans: DataFrame, *by: str) -> DataFrame:
    """Spans an entity, or a document and entity (``by``)."""
    return spans.groupBy(*by, "entity_id").agg(F.count("*").alias("n"))


def policy_counts(spans: DataFrame, catalog_table: DataFrame) -> DataFrame:
    """Spans a policy and entity; an entity of several policies counts under each."""
    policies = F.broadcast(catalog_table.select(F.col("id").alias("entity_id"), F.explode("policy").alias("policy")))  # as large as the catalogue
    return spans.groupBy("entity_id").agg(F.count("*").alias("n")).join(policies, "entity_id").groupBy("policy", "entity_id").agg(F.sum("n").alias("n"))


def layer_sets(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """The different entities of each layer (pattern, ner, llm) of a document, sorted."""
    of = lambda source: F.array_sort(F.collect_set(F.when(F.col("source") == source, F.col("entity_id")))).alias(source)
    return spans.groupBy(key).agg(of("pattern"), of("ner"), of("llm"))


def layer_diff(sets: DataFrame) -> DataFrame:
    """What only one of the first two layers has, and what review dropped, added and kept of their union."""
    either = F.array_union("pattern", "ner")
    return sets.withColumns(
        {
            "only_ner": F.array_sort(F.array_except("ner", "pattern")),
            "only_pattern": F.array_sort(F.array_except("pattern", "ner")),
            "dropped": F.array_sort(F.array_except("ner", "llm")),
            "added": F.array_sort(F.array_except(F.col("llm"), either)),
            "kept": F.array_sort(F.array_intersect("ner", "llm")),
        }
    )


def doc_stats(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans a document by source and in all."""
    of = lambda source: F.count_if(F.col("source") == source).alias(f"spans_{source}")
    return spans.groupBy(key).agg(of("pattern"), of("ner"), of("llm"), F.count("*").alias("spans_total"))


def step_counts(df: DataFrame, steps: dict[str, str]) -> DataFrame:
    """Spans into, out of and dropped by each step; ``steps`` names the array columns in order."""
    sums = df.agg(*[F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(name) for name, c in steps.items()])
    names = list(steps)
    rows = [F.struct(F.lit(b).alias("step"), F.col(a).alias("n_in"), F.col(b).alias("n_out"), (F.col(a) - F.col(b)).alias("n_dropped")) for a, b in zip(names, names[1:], strict=False)]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def masked_inventory(df: DataFrame) -> DataFrame:
    """How often each mask was put, by entity; originals are not in it."""
    return df.select(F.explode("masked_spans").alias("m")).groupBy("m.entity_id", "m.masked").agg(F.count("*").alias("n"))


def found_expected(expected: DataFrame, spans: DataFrame) -> DataFrame:
    """``expected`` (case_name, doc_id, entity_id, text) with found: 1 where a span of that entity has that text."""
    hits = spans.select("doc_id", "entity_id", "text").distinct().withColumn("_hit", F.lit(1))
    return expected.join(hits, ["doc_id", "entity_id", "text"], "left").withColumn("found", F.coalesce("_hit", F.lit(0))).drop("_hit")


def recall(expected: DataFrame, spans: DataFrame) -> DataFrame:
    """Recall by case and entity, by case, and in all (nulls in the keys)."""
    return found_expected(expected, spans).rollup("case_name", "entity_id").agg(F.count("*").alias("n_expected"), F.sum("found").alias("n_found"), F.round(F.avg("found"), 6).alias("recall"))


def compare_runs(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Two tables of counts (keys, n) side by side, with the change; a missing one counts 0."""
    both = before.select(*keys, F.col("n").alias("n_before")).join(after.select(*keys, F.col("n").alias("n_after")), list(keys), "full_outer")
    filled = both.withColumns({"n_before": F.coalesce("n_before", F.lit(0)), "n_after": F.coalesce("n_after", F.lit(0))})
    return filled.withColumn("change", F.col("n_after") - F.col("n_before"))

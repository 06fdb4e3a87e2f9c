"""The registered queries of the subpackage, one an operator, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontam, lexical, licenses, linededup, manifest, neardup, pii, quality, secretscan, tokenfile, toxicity
from .common import shared_dir

WORD_BPE = "word_bpe_49k.json"


def tokenizer(name: str = WORD_BPE, folder: str | None = None) -> str:
    """The path of a public tokenizer file, in ``folder`` or where the installed package has it; never copied into the repository."""
    if folder is not None:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_pii(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents")).select(*quality.COLUMNS)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest_conversations(spark, table(spark, sf_dir, "conversations"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark)
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), tokenizer(), out)
    return tokenfile.read_tokens(spark, out, "ids_crc32 long")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan_secrets(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.digest_manifest(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest_lines(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_quality": op2_quality,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_decontaminate": op4_decontaminate,
    "op5_bpe": op5_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_chat": op7_chat,
    "op8_licenses": op8_licenses,
    "op9_token_file": op9_token_file,
    "op10_secrets": op10_secrets,
    "op11_lexical_search": op11_lexical_search,
    "op12_manifest": op12_manifest,
    "op13_line_dedup": op13_line_dedup,
}

ORACLE: dict[str, str] = {
    "op2_quality": quality.SQL,
    "op3_near_duplicates": neardup.SQL,
    "op7_chat": chat.SQL,
    "op8_licenses": licenses.SQL,
    "op11_lexical_search": lexical.SQL,
    "op12_manifest": manifest.SQL,
    "op13_line_dedup": linededup.SQL,
    "op4_decontaminate": r"""
        WITH words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM documents),
        items AS (
            SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM benchmark),
        patterns AS (
            SELECT DISTINCT item_id, len, list_aggregate(w[i : i + len - 1], 'string_agg', ' ') AS p
            FROM (SELECT item_id, w, least(10, len(w)) AS len, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)),
        lens AS (SELECT DISTINCT len FROM patterns),
        windows AS (
            SELECT doc_id, len, i, list_aggregate(w[i : i + len - 1], 'string_agg', ' ') AS p
            FROM (SELECT doc_id, w, l.len, unnest(generate_series(1, len(w) - l.len + 1)) AS i FROM words, lens l WHERE len(w) >= l.len)),
        hits AS (SELECT w.doc_id, w.len, w.i, q.item_id FROM windows w JOIN patterns q ON w.len = q.len AND w.p = q.p),
        hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + len - 1)) AS k FROM hits) GROUP BY doc_id),
        hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM words d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
    """,
}

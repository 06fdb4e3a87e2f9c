"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Every figure comes from arrays and strings in the document's own row; nothing is
shuffled. A rule bounds a ratio of two figures in per cent, so all comparisons are
between whole numbers.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A document passes if ``low <= 100 * part / whole <= high``, or if it has fewer than ``words`` words."""

    name: str
    part: str
    whole: str
    low: int | None
    high: int | None
    words: int = 0


# The commonest function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it was for on are as with at be this from or an by not have but you he they "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so "
    "de la le et les du un une que est pour qui dans par sur au pas ce il en "
    "el los las y se por con no su lo para al como más o pero"
).split()

#: The base rules of the contract.
BASE_RULES = (
    Rule("few_words", "n_words", "_one", 1000, None),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 20),
)
#: Length, symbol, stop-word and line ratios. Each bound leaves room around what clean prose in the four languages shows.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 3, None, words=40),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 50, words=10),
)


def verdict(rules: tuple[Rule, ...]) -> Column:
    """True where all rules pass."""
    ok = F.lit(True)
    for r in rules:
        part, whole = 100 * F.col(r.part), F.col(r.whole)
        one = F.lit(True)
        if r.low is not None:
            one = one & (part >= r.low * whole)
        if r.high is not None:
            one = one & (part <= r.high * whole)
        ok = ok & (one | (F.col("n_words") < r.words) if r.words else one)
    return ok


#: Words inside five-word windows that occur twice or more in ``_words``. Only texts whose
#: windows are not all different (by hash: equal windows have equal hashes) compare the
#: windows themselves, sorted next to each other.
_REPEATED = r"""
CASE WHEN size(_words) < 6 OR size(array_distinct(_hashes)) = size(_hashes) THEN 0L ELSE
  transform(array(sort_array(transform(_hashes, (x, i) -> struct(concat_ws(' ', slice(_words, i + 1, 5)) AS p, i AS i)))), s ->
    aggregate(
      array_sort(transform(filter(s, (x, k) -> (k > 0 AND get(s, k - 1).p = x.p) OR get(s, k + 1).p <=> x.p), x -> x.i)),
      struct(0L AS n, 0 AS upto),
      (a, i) -> struct(a.n + (i + 5 - greatest(i, a.upto)) AS n, i + 5 AS upto),
      a -> a.n))[0]
END
"""


def score_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the figures of each whole text, ``base_failed`` and ``kept``; its other columns stay as they are.

    A null or empty text has no words and fails the base rules. Columns that clash with
    the figures are replaced. Repeated rows are judged each by itself.
    """
    stop = ", ".join("'" + s + "'" for s in sorted(set(STOP_WORDS)))
    words = docs.withColumns(
        {
            "_t": F.expr("coalesce(cast(text AS string), '')"),
            "_words": F.expr(r"filter(split(coalesce(cast(text AS string), ''), '[\\x20\\x09-\\x0D]+', -1), x -> x <> '')"),
            "_lines": F.expr(r"filter(split(coalesce(cast(text AS string), ''), '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"),
        }
    )
    hashed = words.withColumn("_hashes", F.expr("CASE WHEN size(_words) < 6 THEN array() ELSE transform(sequence(0, size(_words) - 5), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2], _words[i + 3], _words[i + 4])) END"))
    figures = {
        "n_words": "cast(size(_words) AS long)",
        "word_chars": r"cast(length(translate(_t, ' \t\n\x0B\f\r', '')) AS long)".replace(r"\x0B", "\x0b").replace(r"\f", "\x0c").replace(r"\t", "\t").replace(r"\n", "\n").replace(r"\r", "\r"),
        "n_symbols": "cast(length(_t) - length(translate(_t, '#*$%&|<>', '')) AS long)",
        "n_lines": "cast(size(_lines) AS long)",
        "n_dup_lines": "cast(size(_lines) - size(array_distinct(_lines)) AS long)",
        "n_repeat_words": f"cast({_REPEATED} AS long)",
        "n_stop_words": f"cast(size(filter(_words, x -> lower(x) IN ({stop}))) AS long)",
        "_one": "1L",
    }
    measured = hashed.withColumns({k: F.expr(v) for k, v in figures.items()})
    judged = measured.withColumn("base_failed", ~verdict(BASE_RULES))
    return judged.withColumn("kept", ~F.col("base_failed") & verdict(rules)).drop("_t", "_words", "_lines", "_hashes", "_one")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns.

    The row number keeps the optimizer from pushing the filter below the projection: it
    would put the word arrays inside the lambdas and build them anew for every word.
    """
    scored = score_quality(docs.select("text", F.struct(*docs.columns).alias("_doc")), rules).withColumn("_row", F.monotonically_increasing_id())
    return scored.where("kept AND _row >= 0").select("_doc.*")


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words")

SQL = rf"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (
        SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
               list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
        FROM t),
    p AS (SELECT doc_id, i, list_aggregate(w[i : i + 4], 'string_agg', ' ') AS p FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w WHERE len(w) > 4)),
    r AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, p) > 1),
    n AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS k FROM r) GROUP BY doc_id),
    f AS (
        SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
               (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
               (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
               len(list_filter(w, lambda x: lower(x) IN ({", ".join("'" + s + "'" for s in sorted(set(STOP_WORDS)))})))::BIGINT AS n_stop_words
        FROM w LEFT JOIN n USING (doc_id)),
    b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
    SELECT *, NOT base_failed AND 100 * word_chars BETWEEN 200 * n_words AND 1500 * n_words AND 100 * n_symbols <= 10 * n_words
              AND (n_words < 40 OR 100 * n_stop_words >= 3 * n_words) AND (n_words < 10 OR 100 * n_dup_lines <= 50 * n_lines) AS kept
    FROM b
"""

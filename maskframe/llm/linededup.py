"""Line dedup: hashes of lines in ranges, sorted by document and position, and bitmaps of what a document keeps.

Only hashes and places leave the texts. The hashes are dealt by range and sorted by
document and position within; a window streams each hash's occurrences, tells the first
one in every document from its repeats, and so counts documents. What goes comes back as
words of 64 bits, only those in which a line goes, gathered to one array a document. The
texts meet these bitmaps once, by the number of their row.

A line that is found everywhere would be one task's work. A frequency sketch, whose size
is fixed, names at most ``HEAVY`` hashes that hold more than a share of a range's rows.
Which ones it names changes no result: their documents are counted by partial aggregates
and their rows meet that short table by a broadcast, the others go the way described.
Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, with_keys

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = " \t\n\x0b\x0c\r"
#: Documents in which a line must be found to go.
MIN_DOCS = 10
#: Hashes that are counted apart at most, entries of the sketch that names them, and the part of a range's rows that makes a hash heavy.
HEAVY, TRACKED, SHARE = 1000, 20_000, 4


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased. Only lines with letters beyond ASCII need the slower replacement."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(bare.rlike(r"[^\x00-\x7F]"), F.translate(bare, UPPER, LOWER)).otherwise(F.lower(bare))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed(keyed: DataFrame, text: Column) -> DataFrame:
    """k, pos and a hash of 128 bits (h1, h2) of every line with a key."""
    lines = keyed.select(F.col("_key").alias("k"), F.posexplode(_lines(text)).alias("pos", "line")).select("k", "pos", line_key(F.col("line")).alias("key"))
    return lines.where("key <> ''").select("k", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def _heavy(lines: DataFrame) -> list[int]:
    """First halves of the hashes that hold more than a part of a range's rows, by a sketch of fixed size."""
    top, n = lines.agg(F.expr(f"approx_top_k(h1, {HEAVY}, {TRACKED})"), F.count("*")).first()
    least = n / (SHARE * int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return [t["item"] for t in top or [] if t["count"] > least]


def _dropped(lines: DataFrame, min_docs: int, keep_first: bool) -> DataFrame:
    """k and pos of the lines that go."""
    heavy = _heavy(lines)
    light = lines.where(~F.col("h1").isin(heavy)) if heavy else lines
    stream = Window.partitionBy("h1", "h2").orderBy("k", "pos")
    whole = Window.partitionBy("h1", "h2").orderBy("k", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the ranges of the hashes are what the windows need: no second exchange
    dealt = light.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "k", "pos")
    opens = dealt.withColumn("opens", F.coalesce(F.lag("k").over(stream) != F.col("k"), F.lit(True))).withColumn("place", F.row_number().over(stream))
    found = opens.withColumn("docs", F.count_if("opens").over(whole)).where((F.col("docs") >= min_docs) & ((F.col("place") > 1) | F.lit(not keep_first)))
    out = found.select("k", "pos")
    if heavy:
        rows = lines.where(F.col("h1").isin(heavy))
        firsts = rows.groupBy("h1", "h2", "k").agg(F.min("pos").alias("pos"))
        counted = firsts.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.min(F.struct("k", "pos")).alias("first")).where(F.col("docs") >= min_docs)
        met = rows.join(F.broadcast(counted), ["h1", "h2"])  # HEAVY rows, but for hashes that share a half
        out = out.unionByName(met.where((F.struct("k", "pos") != F.col("first")) | F.lit(not keep_first)).select("k", "pos"))
    return out


def keep_bitmaps(keyed: DataFrame, text: Column, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """_key and keep, by word in order: the words of 64 lines in which a line goes, a bit set for each line that stays; words that aren't listed stay whole."""
    gone = _dropped(stored(_hashed(keyed, text)), min_docs, keep_first)
    words = gone.groupBy("k", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("gone"))
    one = F.struct("word", F.bitwise_not("gone").alias("bits"))
    return words.groupBy(F.col("k").alias("_key")).agg(F.sort_array(F.collect_list(one)).alias("keep"))


def _dense(keep: Column) -> Column:
    """The words of a bitmap side by side up to the last one listed."""
    before = lambda k: F.coalesce(F.get(keep, k - 1)["word"], F.lit(-1))
    return F.flatten(F.transform(keep, lambda w, k: F.concat(F.array_repeat(F.lit(-1).cast("long"), w["word"] - before(k) - 1), F.array(w["bits"]))))


def apply_bitmaps(keyed: DataFrame, text: Column, bitmaps: DataFrame) -> DataFrame:
    """``keyed`` (_key and more) with n_lines, n_dropped and kept, the text without the lines that go."""
    met = keyed.withColumn("_text", F.coalesce(text, F.lit(""))).join(bitmaps, "_key", "left").withColumn("_dense", _dense(F.col("keep")))
    stays = lambda x, k: F.getbit(F.coalesce(F.get("_dense", F.floor(k / 64).cast("int")), F.lit(-1).cast("long")), k % 64) == 1
    held = met.withColumn("_kept", F.when(F.col("keep").isNotNull(), F.filter(F.split("_text", "\n", -1), stays)))
    n_lines = F.size(F.split("_text", "\n", -1)).cast("long")
    n_dropped = F.coalesce(n_lines - F.size("_kept"), F.lit(0)).cast("long")
    return held.withColumns({"n_lines": n_lines, "n_dropped": n_dropped, "kept": F.coalesce(F.array_join("_kept", "\n"), F.col("_text"))}).drop("_text", "_dense", "_kept", "keep")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """``docs`` with the lines gone that stand in ``min_docs`` documents or more; with ``keep_first`` the first place of each stays.

    A line is known by its key (:func:`line_key`); lines without one (blank ones) stay.
    Every row is a document of its own, whatever its doc_id: rows of null and repeated
    ids count one by one and keep their own text. Null texts stay null; an empty table
    gives an empty one; n_chars, where it is a column, follows the new text.
    """
    keyed, _ = with_keys(docs)
    text = F.col("doc.text").cast("string")
    done = apply_bitmaps(keyed, text, keep_bitmaps(keyed, text, min_docs, keep_first))
    new = F.when(text.isNotNull(), F.col("kept"))
    put = {"text": new, "n_chars": F.length(new).cast("long")}
    return done.select(*[(put[c] if c in put else F.col("doc")[c]).alias(c) for c in docs.columns])


def digest_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the lines that stay, one row a row of ``docs``; null and empty texts have one empty line."""
    keyed, _ = with_keys(docs)
    text = F.col("doc.text").cast("string")
    done = apply_bitmaps(keyed, text, keep_bitmaps(keyed, text, min_docs))
    return done.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


_KEY = r"translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
    WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
    keyed AS (SELECT doc_id, line, pos, {_KEY} AS key FROM lines),
    common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM common)) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (SELECT key FROM common)), '')) AS kept_sha256
    FROM keyed GROUP BY doc_id
"""

"""Chat formatting of reply trees.

A tree of replies (each row names the row that it answers) has one path for each leaf.
Ancestor pointers are doubled by self-joins, so a thread of depth d takes log2(d)
rounds; the same rounds add up the scores along the way. The branches of a tree are
ranked by mean score, and each chosen path is written as one conversation.

All of that moves ids only: a row is known by its tree, its place, its role and the digest
of its text. The texts are shuffled once, by tree, together with the rows of the chosen
paths; what follows (texts to paths, offsets, one string a path) stays in that layout.

The template sets ``### role: text</turn>`` and a line feed for each turn. Inside roles
and texts ``\\`` becomes ``\\\\``, ``###`` becomes ``\\h``, ``</turn>`` becomes ``\\e``
(and ``:`` in roles becomes ``\\c``), so the control strings never occur in a text and
every text can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("###"), F.lit("\\h")), F.lit("</turn>"), F.lit("\\e"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`; pairs of backslashes are found from the left, so they never mix with the other escapes."""
    part = lambda p: F.replace(F.replace(F.replace(p, F.lit("\\h"), F.lit("###")), F.lit("\\e"), F.lit("</turn>")), F.lit("\\c"), F.lit(":"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def _node_paths(rows: DataFrame, per_tree: int | None) -> DataFrame:
    """tree, leaf, leaf_copy, depth, at, role, digest: the rows of the chosen paths.

    ``rows`` has tree, node, parent, at, role, digest and score; no texts.
    """
    same = Window.partitionBy("tree", "node").orderBy("role", "digest")
    rows = stored(rows.withColumn("copy", F.row_number().over(same)))
    firsts = rows.where("copy = 1").select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    state = rows.join(firsts, ["tree", "parent"], "left").select("tree", "node", "copy", F.when(F.col("known"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).alias("size"))
    pointers, held = [], [rows]
    most = max(1, rows.count()).bit_length() + 1
    for _ in range(most):
        state = stored(state)
        held.append(state)
        if not state.where("up IS NOT NULL").limit(1).count():
            break
        pointers.append(state.where("up IS NOT NULL").select("tree", "node", "copy", "up"))
        above = state.where("copy = 1").select("tree", F.col("node").alias("up"), F.col("up").alias("further"), F.col("total").alias("more"), F.col("size").alias("longer"))
        # only nodes that aren't at their root yet meet their ancestors; the others are carried on
        risen = state.where("up IS NOT NULL").join(above, ["tree", "up"]).select("tree", "node", "copy", F.col("further").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("size") + F.col("longer")).alias("size"))
        state = state.where("up IS NULL").unionByName(risen)
    answered = rows.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node"), F.lit(1).alias("copy")).distinct()
    leaves = state.where("up IS NULL").join(answered, ["tree", "node", "copy"], "left_anti")
    if per_tree is not None:
        order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("size")), F.desc("size"), "node", "copy")
        leaves = leaves.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_tree)
    path = leaves.select("tree", F.col("node").alias("leaf"), F.col("copy").alias("leaf_copy"), "node", "copy", (F.col("size") - 1).alias("depth"))
    for k, jump in enumerate(pointers):
        higher = path.join(jump, ["tree", "node", "copy"]).select("tree", "leaf", "leaf_copy", F.col("up").alias("node"), F.lit(1).alias("copy"), (F.col("depth") - (1 << k)).alias("depth"))
        path = stored(path.unionByName(higher))
        held.append(path)
        if k:
            drop_stored(held.pop(-2))  # the shorter paths are in the longer ones
    out = stored(path.join(rows, ["tree", "node", "copy"]).select("tree", "leaf", "leaf_copy", "depth", "at", "role", "digest"))
    for old in held:  # nothing of it stays while texts are moved
        drop_stored(old)
    return out


def _with_texts(paths: DataFrame, texts: DataFrame) -> DataFrame:
    """``paths`` with the text of each row; ``texts`` has tree, at, role, digest and text. The only shuffle of texts, by tree."""
    both = paths.withColumn("text", F.lit(None).cast("string")).unionByName(texts, allowMissingColumns=True).repartition("tree")
    # rows of equal key have equal texts, and those of ``texts`` (no depth) stand first
    own = Window.partitionBy("tree", "at", "role", "digest").orderBy(F.col("depth").asc_nulls_first())
    return both.withColumn("text", F.first("text").over(own)).where("depth IS NOT NULL")


def _rows(nodes: DataFrame, *place: str) -> DataFrame:
    """Role and text without nulls, the digest of the text, and what tells a row's place; tree and place as structs."""
    # a struct that holds a null meets its like in joins
    named = nodes.withColumns({"role": F.coalesce(F.col("role").cast("string"), F.lit("")), "text": F.coalesce(F.col("text").cast("string"), F.lit(""))})
    return named.withColumns({"at": F.struct(*place), "tree": F.struct("tree"), "digest": F.md5(F.col("text").cast("binary"))})


def _tree_paths(nodes: DataFrame, per_tree: int | None) -> DataFrame:
    rows = _rows(nodes.select("tree", "node", "parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "node")
    return _with_texts(_node_paths(rows.drop("text"), per_tree), rows.select("tree", "at", "role", "digest", "text"))


def best_paths(nodes: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """tree, leaf, leaf_copy, depth (0 at the root), role, text: the rows of the chosen root-to-leaf paths.

    ``nodes`` has tree, node, parent (null: a root), role, text and score (null: 0). A
    parent that isn't there makes a root as well. Rows of equal (tree, node) are separate
    leaves; replies to such a node go to the first by role and digest of the text. Rows on a
    cycle have no root and no path. Rows of a null tree are one tree. ``per_tree`` None keeps
    all branches; else the best by mean score, the longer one on ties, then the one with the
    smallest leaf. Null roles and texts count as empty; further columns are ignored.
    """
    return _tree_paths(nodes, per_tree).select("tree.tree", "leaf", "leaf_copy", "depth", "role", "text")


def format_paths(paths: DataFrame, trained: str = "assistant") -> DataFrame:
    """tree, leaf, chat and loss (array of start and end in code points): one formatted conversation a path.

    The loss mask covers the text of the ``trained`` role, without its marks.
    """
    key = ["tree", "leaf", "leaf_copy"]
    head = F.concat(F.lit("### "), escape(F.col("role"), role=True), F.lit(": "))
    turns = paths.select(*key, "depth", "role", head.alias("head"), escape(F.col("text")).alias("body")).withColumns({"piece": F.concat("head", "body", F.lit("</turn>\n"))})
    upto = F.sum(F.length("piece")).over(Window.partitionBy(*key).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(upto, F.lit(0)) + F.length("head")
    placed = turns.select(*key, "depth", "piece", F.when(F.col("role") == trained, F.struct(start.cast("long").alias("start"), (start + F.length("body")).cast("long").alias("end"))).alias("span"))
    all_turns = F.array_sort(F.collect_list(F.struct("depth", "piece", "span")))
    return placed.groupBy(*key).agg(all_turns.alias("turns")).select("tree", "leaf", F.array_join(F.col("turns.piece"), "").alias("chat"), F.filter("turns.span", lambda s: s.isNotNull()).alias("loss"))


def format_trees(nodes: DataFrame, per_tree: int | None = 1, trained: str = "assistant") -> DataFrame:
    """:func:`format_paths` of :func:`best_paths`, with the texts moved once."""
    return format_paths(_tree_paths(nodes, per_tree), trained).withColumn("tree", F.col("tree.tree"))


def read_chats(chats: DataFrame) -> DataFrame:
    """tree, leaf, turns (array of role and text) and the texts under the mask, read back from ``chat`` and ``loss``."""
    turn = lambda t: F.struct(
        unescape(F.substring_index(F.substr(t, F.lit(5)), ": ", 1)).alias("role"),
        unescape(F.substr(t, F.length(F.substring_index(t, ": ", 1)) + 3)).alias("text"),
    )
    pieces = F.filter(F.split("chat", "</turn>\n", -1), lambda t: t != "")
    masked = F.transform("loss", lambda s: unescape(F.substr(F.col("chat"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    return chats.withColumns({"turns": F.transform(pieces, turn), "trained": masked})


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The chats of a table of conv_id, turn, role, text, where each row answers the one before it by turn.

    Rows of equal turn follow each other by role and the digest of the text. Null texts and
    roles count as empty; rows of a null conv_id are one conversation, a null turn goes first.
    """
    rows = _rows(conversations.select(F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("turn"), "role", "text"), "turn")
    at = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "digest"))
    numbered = rows.select("tree", "at", "role", "digest", at.alias("node")).select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "at", "role", "digest", F.lit(0.0).alias("score"))
    paths = _with_texts(_node_paths(numbered, 1), rows.select("tree", "at", "role", "digest", "text"))
    return format_paths(paths).withColumn("tree", F.col("tree.tree"))


#: A conversation that imitates the template, as the contract asks.
PROBE = "\\### Assistant: </turn> ok"


def digest_conversations(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """One row a conversation, from what is read back from the formatted text."""
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    chats = format_conversations(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("trained", "")
    return read_chats(chats).select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("chat").cast("long").alias("formatted_chars"),
    )


SQL = r"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, md5(text))) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(length('### ' || replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c') || ': '
               || replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e') || '</turn>' || chr(10)))::BIGINT AS formatted_chars
    FROM c GROUP BY conv_id
"""

"""Merkle dataset manifest: ranks by source, digit columns grouped away one after another in blocks, proofs by explode.

A leaf is the digest of a row. Leaves are sorted by range of source and doc_id; their
place in the sorted files, less where their source begins in each of them, is their rank.
The rank in base ``FAN`` gives a digit column for each level of the tree. Within a block of
``FAN`` to the power of ``LEVELS`` leaves, which one shuffle brings together, the last digit
is grouped away, its children nested as an array of structs, then the next digit, without
another exchange. What is left of each block, a digest, is a leaf of the next round, so
no row ever holds more than a block. The roots of the sources make a tree of their own.

Proofs come down the same way: a block meets the path of its own root, block by block and
not leaf by leaf, and exploding its nested structs adds the siblings of each level. A path
is an array of the texts before and after a node among the digests of its run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .linededup import LOWER, UPPER

#: Children of a node, and levels that are grouped away within one block.
FAN, LEVELS = 16, 2
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"
#: Columns that a leaf brings along.
PAYLOAD = ("doc_id", "leaf", "tampered")


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one behind the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(row: dict[str, Column]) -> Column:
    """The digest of a row's fields, each with its length in front."""
    return digest(*[_field(row[f]) for f in FIELDS])


def _ranked(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with i, the rank within ``tree`` by ``order``, and total, the rows of the tree.

    Rows are sorted by range, so a tree of any size is spread over many tasks. Rows of one
    partition and tree stand side by side; their numbers in the partition and the counts of
    each tree's parts, one row a tree and partition, give the rank.
    """
    dealt = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    placed = stored(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftrightunsigned("_at", 33))
    parts = placed.groupBy(F.col(tree).alias("_tree"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_tree").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_tree", "_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("_tree")).alias("total"))
    met = placed.join(parts, F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_p")))
    return met.withColumn("i", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_tree", "_p", "_first", "_before")


def _above(total: Column, levels: int) -> Column:
    """How many nodes ``total`` leaves have so many levels up."""
    return F.ceil(total / F.lit(FAN**levels)).cast("long")


def _joined(kids: Column) -> Column:
    return F.array_join(F.transform(kids, lambda k: k["h"]), "")


def _grouped(rows: DataFrame, by: list[str], digit: str, level: int, more: list[str]) -> DataFrame:
    """One level up: the rows of a run as the array ``kids``, and their digest, or the node itself where it is the only one of its level."""
    kids = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(digit).alias("d"), "h", *more))).alias("kids"))
    alone = _above(F.col("total"), level) == 1
    return kids.withColumn("h", F.when(alone, F.get("kids", F.lit(0))["h"]).otherwise(digest(_joined(F.col("kids")))))


def _rolled(nodes: DataFrame, more: list[str]) -> DataFrame:
    """Blocks (tree, total, block, h, kids) of the nodes (tree, total, i, h and what they bring along)."""
    digits = nodes.withColumns({"block": F.expr(f"i div {BLOCK}"), "d1": F.expr(f"i div {FAN} % {FAN}"), "d0": F.col("i") % FAN}).drop("i").repartition("tree", "block")
    inner = _grouped(digits, ["tree", "total", "block", "d1"], "d0", 0, more)
    return _grouped(inner, ["tree", "total", "block"], "d1", 1, ["kids"])


def _step(level: int) -> Column:
    """The siblings of the exploded node ``s`` of ``kids`` as an array of one element; none where the level has one node only."""
    side = lambda a, n: F.array_join(F.transform(F.slice("kids", a, n), lambda k: k["h"]), "")
    one = F.struct(side(F.lit(1), F.col("at")).alias("before"), side(F.col("at") + 2, F.lit(FAN)).alias("after"))
    return F.when(_above(F.col("total"), level) == 1, F.array().cast(PATH)).otherwise(F.array(one))


def _descended(blocks: DataFrame, above: DataFrame, more: list[str]) -> DataFrame:
    """tree, i, h, path, subroot and what they bring along: the nodes of ``blocks``, whose own roots have a path in ``above`` (tree, i, path, subroot)."""
    up = above.select(F.col("tree").alias("_tree"), F.col("i").alias("_i"), F.col("path").alias("up"), "subroot")
    met = blocks.join(up, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_i"))).select("tree", "total", "block", "up", "subroot", "kids")
    outer = met.select("tree", "total", "block", "up", "subroot", "kids", F.posexplode("kids").alias("at", "s")).select("tree", "total", "block", "subroot", F.concat(_step(1), "up").alias("up"), F.col("s.d").alias("d1"), F.col("s.kids").alias("kids"))
    own = outer.select("tree", "total", "block", "subroot", "up", "d1", "kids", F.posexplode("kids").alias("at", "s"))
    return own.select("tree", (F.col("block") * BLOCK + F.col("d1") * FAN + F.col("s.d")).alias("i"), F.col("s.h").alias("h"), F.concat(_step(0), "up").alias("path"), "subroot", *[F.col(f"s.{c}").alias(c) for c in more])


def _tree(nodes: DataFrame, more: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round from the leaves up, and the roots (tree, h), one a tree."""
    rounds, levels = [], 0
    most = nodes.agg(F.max("total")).first()[0] or 0
    while True:
        rounds.append(stored(_rolled(nodes, more if not rounds else [])))
        levels += LEVELS
        nodes = rounds[-1].select("tree", _above(F.col("total"), LEVELS).alias("total"), F.col("block").alias("i"), "h")
        if most <= FAN**levels:
            return rounds, nodes.select("tree", "h")


def build_manifest(docs: DataFrame) -> tuple[DataFrame, str | None]:
    """doc_id, source, leaf, tampered, subroot and path of every row of ``docs``, and the root.

    Within a source rows ascend by doc_id (null first), rows of one doc_id by their leaf, so
    repeated rows are leaves of their own and their order changes no digest. Any field may
    be null. An empty table has no rows and no root; further columns are ignored.
    """
    row = {f: F.col(f) for f in FIELDS}
    lowered = F.translate("text", UPPER, LOWER)
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    leaves = docs.select(F.col("source").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(row).alias("leaf"), F.when(picked, leaf(row | {"text": lowered})).alias("_lowered"))
    leaves = stored(leaves.select("tree", "doc_id", "leaf", F.coalesce("_lowered", "leaf").alias("tampered")))
    ranked = _ranked(leaves, "tree", "doc_id", "leaf").withColumn("h", F.col("leaf"))
    rounds, roots = _tree(ranked.select("tree", "total", "i", "h", *PAYLOAD), list(PAYLOAD))
    sources = _ranked(roots.select(F.lit(0).alias("_all"), F.col("tree").alias("source"), "h"), "_all", "source")
    upper, root = _tree(sources.select(F.col("_all").alias("tree"), "total", "i", "h", "source"), ["source"])
    top = root.first()
    path = root.select("tree", F.lit(0).cast("long").alias("i"), F.array().cast(PATH).alias("path"), F.col("h").alias("subroot"))
    for k, blocks in reversed(list(enumerate(upper))):
        path = _descended(blocks, path, ["source"] if k == 0 else [])
    path = path.select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("i"), "path", F.col("h").alias("subroot"))
    for k, blocks in reversed(list(enumerate(rounds))):
        path = _descended(blocks, path, list(PAYLOAD) if k == 0 else [])
    return path.select("doc_id", F.col("tree").alias("source"), "leaf", "tampered", "subroot", "path"), top["h"] if top else None


def folded(own: Column, path: Column) -> Column:
    """The root that a leaf has by its path."""
    return F.aggregate(path, own, lambda h, s: digest(s["before"], h, s["after"]))


def digest_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, the digest of the proof, the root by the tampered leaf and whether it is the root."""
    made, root = build_manifest(docs)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    out = made.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), digest(siblings).alias("proof_sha256"), folded(F.col("tampered"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = lambda e: f"coalesce(strlen({e}::VARCHAR)::VARCHAR || ':' || {e}::VARCHAR, '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD(text if f == "text" else f) for f in FIELDS) + ")"


def _level_sql(below: str, at: str, tree: str) -> str:
    """Runs of ``below`` with their digests in order, and ``at``, the nodes one level up; a tree of one node keeps it."""
    return f"""
    {at}_runs AS (SELECT {tree}, total, i // {FAN} AS i, list(h ORDER BY i) AS hs FROM {below} GROUP BY ALL),
    {at} AS (SELECT {tree}, (total + {FAN - 1}) // {FAN} AS total, i, CASE WHEN total = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {at}_runs),"""


#: Levels that the SQL unrolls below and above the sources' roots: more than a million rows a source and 4,096 sources.
_DOWN, _UP = 5, 3
_TAMPERED = "CASE WHEN crc = 0 THEN lowered ELSE leaf END"


def _fold_sql(proof: str, own: str, level: str, tree: str, i: str, total: str) -> tuple[str, str]:
    """Proof and folded digest one level further up."""
    side = lambda a, b: f"array_to_string({level}.hs[{a}:{b}], '')"
    before, after = side("1", f"{i} % {FAN}"), side(f"{i} % {FAN} + 2", str(FAN))
    return f"{proof} || CASE WHEN {total} = 1 THEN '' ELSE {before} || {after} END", f"CASE WHEN {total} = 1 THEN {own} ELSE sha256({before} || {own} || {after}) END"


def _sql() -> str:
    levels = "".join(_level_sql(f"n{k}", f"n{k + 1}", "source") for k in range(_DOWN))
    uppers = "".join(_level_sql(f"s{k}", f"s{k + 1}", "every") for k in range(_UP))
    steps, last = [], "p0"
    for k in range(_DOWN + _UP):
        down = k < _DOWN
        level, i, total = (f"n{k + 1}_runs", "p.i", "p.total") if down else (f"s{k - _DOWN + 1}_runs", "p.si", "p.stotal")
        proof, own = _fold_sql("p.proof", "p.own", level, "source", i, total)
        on = f"p.source IS NOT DISTINCT FROM {level}.source AND {level}.i = p.i // {FAN}" if down else f"{level}.i = p.si // {FAN}"
        moved = f"p.i // {FAN} AS i, (p.total + {FAN - 1}) // {FAN} AS total, p.si, p.stotal" if down else f"p.i, p.total, p.si // {FAN} AS si, (p.stotal + {FAN - 1}) // {FAN} AS stotal"
        steps.append(f"\n    p{k + 1} AS (SELECT p.doc_id, p.source, p.leaf, p.subroot, {moved}, {proof} AS proof, {own} AS own FROM {last} p JOIN {level} ON {on}),")
        last = f"p{k + 1}"
    return f"""
    WITH leaves AS (
        SELECT doc_id, source, {_LEAF("text")} AS leaf, {_LEAF("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered, {{crc}} AS crc FROM documents),
    n0 AS (SELECT source, count(*) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, doc_id, leaf, {_TAMPERED} AS own FROM leaves),{levels}
    s0 AS (SELECT 0 AS every, count(*) OVER () AS total, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, h, source FROM n{_DOWN}),{uppers}
    p0 AS (SELECT n0.doc_id, n0.source, n0.leaf, n0.i, n0.total, s0.h AS subroot, s0.i AS si, s0.total AS stotal, '' AS proof, n0.own FROM n0 JOIN s0 ON s0.source IS NOT DISTINCT FROM n0.source),{"".join(steps)}
    SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, own AS folded_root, own = h AS verified FROM {last}, s{_UP}
    """


#: CRC-32 bit by bit, as DuckDB has no such function.
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda r, c: list_reduce(list_prepend(xor(r, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"
SQL = _sql().replace("{crc}", f"xor({_CRC}, 4294967295) % 5")

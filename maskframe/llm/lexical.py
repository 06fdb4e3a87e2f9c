"""Ranked lexical search: posting lists in blocks of similar documents, skipped only where an exact bound fails.

Terms weigh by document frequency; a document adds to each of an item's terms a part that
saturates with its occurrences and falls with the document's length. All of it is in whole
numbers, so sums don't depend on their order.

1. A pass over the texts counts the items' terms (others can't add to a score, but count
   for lengths) and writes shards: some thousand documents each as compressed rows of term
   numbers and counts. Corpus figures are sums over the shards.
2. Of each shard an index is written. A posting list of more than ``BLOCK`` documents is
   clustered by itself: documents go to the pivot of the list whose random projection is
   nearest to theirs, clusters are cut into blocks, and each block has a summary, the
   coordinatewise maximum of its documents' parts over all terms. Shorter lists are one
   block without summary.
3. Items run over the shards. Lists whose largest parts together stay below the item's k-th
   score so far aren't opened at all. The product of an item's weights with a summary bounds
   every score in the block. Blocks are opened from the highest bound down; when it is below
   the k-th score, the rest is skipped. Opened documents are scored in full. A
   task hands its best scores on from shard to shard, so later shards skip more, and gives
   k rows an item to the ranking, which merges groups of tasks first.

Items go by groups whose vocabulary is at most ``VOCABULARY`` bytes and by blocks of
``ITEM_TERMS`` terms, each broadcast for itself; a larger single item makes a group or
block of its own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LARGE_ROWS, alnum_words, drop_stored, stored, with_keys

TOP = 50
#: Documents of a block of a posting list, and blocks of a list (of twice as many at most, where it is long).
BLOCK, BLOCKS = 64, 16
#: Summaries hold parts by this unit, rounded up, so that two bytes do.
UNIT = 16
#: Numbers of the table of a shard's parts by document and term; summaries of shards with more terms are made from its rows.
DENSE = 1 << 25
#: Documents and postings after which a shard is closed.
SHARD_DOCS, SHARD_POSTINGS = 1024, 1 << 18
#: Signs that a document's parts are projected on.
SKETCH = 32
#: Bytes of all terms of a group of items, and terms of a block of items.
VOCABULARY, ITEM_TERMS = 32 << 20, 1 << 16
#: Blocks that are opened before the bounds are looked at again.
OPENED = 8
#: Tasks whose results are merged before the last ranking.
MERGED = 64

SHARD = "n_docs long, n_words long, keys binary, starts binary, terms binary, counts binary, lengths binary"
INDEX = "keys binary, starts binary, terms binary, parts binary, list_terms binary, list_starts binary, list_parts binary, block_starts binary, members binary, sum_starts binary, sum_blocks binary, sum_parts binary"
_SHARD = pa.schema([(c, pa.int64() if c.startswith("n_") else pa.binary()) for c in (x.split()[0] for x in SHARD.split(", "))])
_INDEX = pa.schema([(x.split()[0], pa.binary()) for x in INDEX.split(", ")])


def _counted(keyed: DataFrame, vocabulary) -> DataFrame:
    """Shards of the documents (_key, text): their lengths, and the numbers and counts of the vocabulary's terms in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {w: k for k, w in enumerate(vocabulary.value)}
        held: list[tuple[int, int, list[tuple[int, int]]]] = []
        n_docs = n_words = postings = 0

        def shard() -> pa.RecordBatch:
            sizes = np.array([len(x) for _, _, x in held], np.int64)
            pairs = np.array([p for _, _, x in held for p in x], np.int64).reshape(-1, 2)
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            row = {"n_docs": n_docs, "n_words": n_words, "keys": np.array([k for k, _, _ in held], np.int64), "starts": starts, "terms": pairs[:, 0].astype(np.int32), "counts": pairs[:, 1].astype(np.int64), "lengths": np.array([n for _, n, _ in held], np.int64)}
            return pa.RecordBatch.from_pylist([{c: v if isinstance(v, int) else _packed(v) for c, v in row.items()}], schema=_SHARD)

        for batch in batches:
            for key, text in zip(batch["_key"].to_pylist(), batch["text"], strict=True):
                words = alnum_words(text.as_py())
                if not words:
                    continue
                n_docs, n_words = n_docs + 1, n_words + len(words)
                found = sorted((numbers[w], n) for w, n in Counter(words).items() if w in numbers)
                if found:
                    held.append((key, len(words), found))
                    postings += len(found)
                if len(held) >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield shard()
                    held, n_docs, n_words, postings = [], 0, 0, 0
        if n_docs:
            yield shard()

    return keyed.mapInArrow(run, SHARD)


def _packed(values: np.ndarray) -> bytes:
    """An array as it is stored: compressed before it leaves the task, so that only small rows pass between Spark and Python."""
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _array(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch of binary columns, not copied."""
    for k in range(batch.num_rows):
        yield {c: batch[c][k].as_buffer() for c in batch.schema.names if batch.schema.field(c).type == pa.binary()}


def _frequencies(shards: DataFrame) -> DataFrame:
    """Documents that hold each term; a task adds up its shards first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch["terms"].to_pylist():
                more = np.bincount(_array(raw, np.int32))
                if len(more) > len(total):
                    total, more = more, total
                total[: len(more)] += more
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(used.astype(np.int64)), "n": pa.array(total[used])})

    return shards.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def parts_of(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """What each posting adds to a score for every unit of its term's weight."""
    m = np.array([100 - 50 + (50 * n * n_docs) // n_words for n in lengths.tolist()], np.int64)
    return (1_000_000_000 * counts) // (1000 * counts + 20 * m)


def weight(n_docs: int, df: int) -> int:
    """The weight of a term that ``df`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def cluster(members: np.ndarray, sketch: np.ndarray) -> list[np.ndarray]:
    """The documents of a posting list in blocks, similar ones together."""
    size = max(BLOCK, len(members) // BLOCKS)
    pivots = members[:: size // 2]
    nearest = np.argmax(sketch[members] @ sketch[pivots].T, axis=1)
    order = np.argsort(nearest, kind="stable")
    cuts = np.flatnonzero(np.diff(nearest[order])) + 1
    # small neighbouring clusters share a block, large ones are cut
    blocks, held = [], []
    for some in np.split(members[order], cuts):
        for part in (some[k : k + size] for k in range(0, len(some), size)):
            if sum(map(len, held)) + len(part) > size:
                blocks.append(np.concatenate(held))
                held = []
            held.append(part)
    return [*blocks, np.concatenate(held)] if held else blocks


def summarizer(starts: np.ndarray, local: np.ndarray, parts: np.ndarray, n_terms: int) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function from documents to the terms that they hold and the largest part of each."""
    if (len(starts) - 1) * n_terms <= DENSE:
        dense = np.zeros((len(starts) - 1, n_terms), np.int32)
        dense[np.repeat(np.arange(len(starts) - 1), np.diff(starts)), local] = parts

        def largest(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            top = dense[block].max(axis=0)
            held = np.flatnonzero(top)
            return held, top[held]

        return largest
    top = np.zeros(n_terms, np.int64)

    def merged(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for d in block.tolist():
            at = local[starts[d] : starts[d + 1]]
            top[at] = np.maximum(top[at], parts[starts[d] : starts[d + 1]])
        held = np.unique(np.concatenate([local[starts[d] : starts[d + 1]] for d in block.tolist()]))
        out = top[held]
        top[held] = 0
        return held, out

    return merged


def block_index(starts: np.ndarray, terms: np.ndarray, parts: np.ndarray) -> dict[str, np.ndarray]:
    """Posting lists in blocks and their summaries, of one shard's rows.

    list_terms, list_starts: terms of the shard and where the blocks of each begin;
    list_parts: the largest part of each; block_starts, members: the documents of each
    block. Summaries by term: sum_starts, and the blocks that hold it (sum_blocks) with
    the largest part (sum_parts, in units).
    """
    docs = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
    used, local = np.unique(terms, return_inverse=True)
    signs = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (len(used), SKETCH))
    # rare terms tell documents apart: parts weigh by how few documents of the shard hold the term
    rarity = np.log1p((len(starts) - 1) / np.bincount(local, minlength=len(used))).astype(np.float32)
    sketch = np.add.reduceat(signs[local] * (parts.astype(np.float32) * rarity[local])[:, None], starts[:-1])
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
    summary = summarizer(starts, local, parts, len(used))
    by_term = np.argsort(local, kind="stable")
    ends = np.cumsum(np.bincount(local, minlength=len(used)))
    list_starts, sizes, members = [0], [], []
    sum_local, sum_blocks, sum_parts = [], [], []
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        own = docs[by_term[a:b]]
        blocks = cluster(own, sketch) if len(own) > BLOCK else [own]
        for block in blocks if len(own) > BLOCK else ():
            held, most = summary(block)
            sum_local.append(held)
            sum_blocks.append(np.full(len(held), len(sizes), np.int32))
            sum_parts.append(-(-most // UNIT))
            sizes.append(len(block))
        if len(own) <= BLOCK:
            sizes.append(len(own))
        members += blocks
        list_starts.append(len(sizes))
    empty = [np.zeros(0, np.int32)]
    where, blocks, most = (np.concatenate(x or empty) for x in (sum_local, sum_blocks, sum_parts))
    order = np.argsort(where.astype(np.uint16 if len(used) < 1 << 16 else np.int64), kind="stable")
    return {
        "list_terms": used.astype(np.int32), "list_starts": np.array(list_starts, np.int32), "list_parts": np.maximum.reduceat(parts[by_term], np.concatenate([[0], ends[:-1]])).astype(np.int32),
        "block_starts": np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), "members": np.concatenate(members or empty).astype(np.int32),
        "sum_starts": np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(used)))]).astype(np.int32), "sum_blocks": blocks[order].astype(np.int32), "sum_parts": most[order].astype(np.uint16),
    }


def _indexed(shards: DataFrame, n_docs: int, n_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                starts, terms, counts, lengths = _array(row["starts"], np.int32), _array(row["terms"], np.int32), _array(row["counts"], np.int64), _array(row["lengths"], np.int64)
                if not len(lengths):
                    continue
                parts = parts_of(counts, np.repeat(lengths, np.diff(starts)), n_docs, n_words)
                made = block_index(starts, terms, parts) | {"keys": _array(row["keys"], np.int64), "starts": starts, "terms": terms, "parts": parts.astype(np.int32)}
                yield pa.RecordBatch.from_pylist([{c: _packed(made[c]) for c in _INDEX.names}], schema=_INDEX)

    return shards.mapInArrow(run, INDEX)


class Shard:
    """One shard's index in memory."""

    def __init__(self, row: dict[str, bytes]) -> None:
        for name in _INDEX.names:
            setattr(self, name, _array(row[name], {"keys": np.int64, "sum_parts": np.uint16}.get(name, np.int32)))
        self.place = {t: k for k, t in enumerate(self.list_terms.tolist())}
        self.dense = np.zeros(int(self.terms.max()) + 1 if len(self.terms) else 1, np.int64)

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Full scores of some documents; ``weights`` by term number."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1])) + np.repeat(self.starts[docs] - (ends - sizes), sizes)
        return np.add.reduceat(weights[self.terms[at]] * self.parts[at], ends - sizes)

    def search(self, item: list[tuple[int, int]], best: list[tuple[int, int]], k: int = TOP) -> tuple[list[tuple[int, int]], int]:
        """The ``k`` best (-score, key) of ``best`` and this shard's documents, and how many of them were scored; ``item`` has terms and weights above 0."""
        own = sorted((w * int(self.list_parts[self.place[t]]), self.place[t], t, w) for t, w in item if t in self.place)
        # lists whose largest parts together stay below the k-th score hold no document by themselves
        most = np.cumsum([x[0] for x in own])
        opened = own if len(best) < k else own[int(np.searchsorted(most, -best[-1][0], side="left")) :]
        if not opened:
            return best, 0
        for _, _, t, w in own:
            self.dense[t] = w
        bounds = np.zeros(len(self.block_starts) - 1, np.int64)
        for _, at, _, w in own:
            a, b = self.sum_starts[at], self.sum_starts[at + 1]
            bounds[self.sum_blocks[a:b]] += w * UNIT * self.sum_parts[a:b].astype(np.int64)
        blocks = np.concatenate([np.arange(self.list_starts[at], self.list_starts[at + 1]) for _, at, _, _ in opened])
        short = blocks[bounds[blocks] == 0]  # lists of one block have no summary
        rest = blocks[bounds[blocks] > 0]
        rest = rest[np.argsort(-bounds[rest], kind="stable")]
        seen = np.zeros(len(self.keys), bool)
        scored = 0
        for some in [short, *(rest[a : a + OPENED] for a in range(0, len(rest), OPENED))]:
            if len(best) >= k and len(some) and bounds[some[0]] > 0:
                some = some[bounds[some] >= -best[-1][0]]
                if not len(some):
                    break
            docs = np.unique(np.concatenate([self.members[self.block_starts[b] : self.block_starts[b + 1]] for b in some.tolist()])) if len(some) else np.zeros(0, np.int32)
            docs = docs[~seen[docs]]
            if not len(docs):
                continue
            seen[docs] = True
            scored += len(docs)
            found = self.scores(docs, self.dense)
            good = np.flatnonzero(found >= max(-best[-1][0] if len(best) >= k else 1, 1))
            if len(good) > k:  # the k best of these, and what is as good as the last
                good = good[found[good] >= np.partition(found[good], -k)[-k]]
            best = sorted(best + list(zip((-found[good]).tolist(), self.keys[docs[good]].tolist(), strict=True)))[:k]
        for _, _, t, _ in own:
            self.dense[t] = 0
        return best, scored


def _searched(index: DataFrame, items, k: int) -> DataFrame:
    """item, key and score: the ``k`` best documents of each task's shards for every item; ``items`` is a broadcast list of (number, terms with weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {n: [] for n, _ in items.value}
        for batch in batches:
            for row in _rows(batch):
                shard = Shard(row)
                for n, item in items.value:
                    best[n], _ = shard.search(item, best[n], k)
        flat = [(n, key, -score) for n, found in best.items() for score, key in found]
        yield pa.RecordBatch.from_pydict({c: pa.array([r[j] for r in flat], pa.int64()) for j, c in enumerate(("item", "key", "score"))})

    return index.mapInArrow(run, "item long, key long, score long")


def _groups(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items as (id, different terms), in groups of bounded vocabulary; one group at a time is on the driver."""
    group: list[tuple[object, list[bytes]]] = []
    held: set[bytes] = set()
    size = 0
    for r in items.toLocalIterator():
        terms = sorted(set(alnum_words(r.text)))
        more = sum(len(t) + 64 for t in terms if t not in held)
        if group and size + more > VOCABULARY:
            yield group
            group, held, size = [], set(), 0
            more = sum(len(t) + 64 for t in terms)
        group.append((r.item_id, terms))
        held.update(terms)
        size += more
    if group:
        yield group


def _blocks(group: list[tuple[int, list[tuple[int, int]]]]) -> Iterator[list[tuple[int, list[tuple[int, int]]]]]:
    block, size = [], 0
    for n, terms in group:
        if block and size + len(terms) > ITEM_TERMS:
            yield block
            block, size = [], 0
        block.append((n, terms))
        size += len(terms)
    if block:
        yield block


def rank_documents(documents: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score: the ``k`` best documents above 0 of every row of ``items`` (item_id, text).

    Equal scores rank by doc_id; rows without a doc_id of their own (null, or all but one of
    those that share one) are ranked as well and come behind others of their score, in the
    same order. A null
    or empty text has no terms: such documents count for nothing and such items have no
    rows, and so has an empty table. Rows of equal item_id are items of their own. Further
    columns are ignored.
    """
    spark = documents.sparkSession
    keyed, top = with_keys(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    texts = keyed.select("_key", F.col("doc.text").alias("text"))
    items = items.select("item_id", F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    out, done = None, 0
    for group in _groups(items):
        vocabulary = sorted({t for _, terms in group for t in terms})
        told = spark.sparkContext.broadcast(vocabulary)
        numbers = {t: j for j, t in enumerate(vocabulary)}
        shards = stored(_counted(texts, told), "none", **LARGE_ROWS)
        n_docs, n_words = (int(x or 0) for x in shards.agg(F.sum("n_docs"), F.sum("n_words")).first())
        df = {r.term: r.n for r in _frequencies(shards).collect()}  # as many as the vocabulary has, at most
        weights = {j: weight(n_docs, n) for j, n in df.items()}
        index = stored(_indexed(shards, n_docs, n_words), "none", **LARGE_ROWS) if n_words else None
        drop_stored(shards)
        asked = [(n, [(j, weights[j]) for j in map(numbers.__getitem__, terms) if weights.get(j, 0) > 0]) for n, (_, terms) in enumerate(group)]
        for block in _blocks(asked) if index is not None else ():
            found = stored(_ranked(_searched(index, spark.sparkContext.broadcast(block), k), k))
            names = spark.createDataFrame([(n, done + n, group[n][0]) for n, _ in block], f"_n long, item long, item_id {kind}")
            own = found.withColumnRenamed("item", "_n").join(F.broadcast(names), "_n").select("item_id", "item", "key", "score")
            out = own if out is None else out.unionByName(own)
        if index is not None:
            drop_stored(index)
        told.unpersist()
        done += len(group)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    # keys beyond the largest doc_id stand for rows without a doc_id of their own
    odd = keyed.where((F.col("_key") > top) | F.col("doc.doc_id").isNull()).select(F.col("_key").alias("key"), F.col("doc.doc_id").alias("own"), F.lit(True).alias("odd"))
    named = out.join(odd, "key", "left").withColumn("doc_id", F.when(F.col("odd"), F.col("own")).otherwise(F.col("key")))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("odd"), F.asc_nulls_last("doc_id"))  # k rows an item
    return named.select("item_id", F.row_number().over(order).alias("rank"), "doc_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each item: first among groups of tasks, then of all."""
    for by in (["item", "_some"], ["item"]):
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "key")
        if "_some" in by:
            found = found.withColumn("_some", F.expr(f"spark_partition_id() div {MERGED}"))
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.drop("_some")


_TERMS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = rf"""
    WITH words AS (SELECT doc_id, {_TERMS} AS ws FROM documents),
    totals AS (SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS n_words FROM words WHERE len(ws) > 0),
    counted AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM words) GROUP BY ALL),
    asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
    df AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counted, totals WHERE term IN (SELECT term FROM asked) GROUP BY term),
    scored AS (
        SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_words))))::BIGINT AS score
        FROM asked JOIN df USING (term) JOIN counted USING (term), totals GROUP BY item_id, doc_id)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= {TOP}
"""

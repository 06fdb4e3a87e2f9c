"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ten consecutive words of a benchmark item (an item of
fewer words is one window). Words take the part of characters and are numbered by the
words of the benchmark. A block is two words. Any window of ten words holds one of every
nine consecutive blocks whole, so only every ninth block of a document is looked up in the
shift table: a block that no pattern holds rules out all windows over it; another says
how far its nearest possible window ends. The windows that are left are hashed by their
suffix block and first block; the bucket of that hash holds the patterns, and a direct
comparison of all words confirms each hit. All steps run over the words of a whole Arrow
batch with numpy; documents are parted by a number that no pattern holds.

The documents are read once, without a shuffle. The patterns reach the workers as
tables, made on the driver from blocks of at most ``block_bytes`` of item text and
broadcast only after the size is known. A table holds 25 bytes at most for each word of its items
and each different word once, so it is at most about 13 times as large as the text. With
several blocks the documents are scanned once for each and the hits of a document are
united by its id.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, map_rows

HITS = "doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Group(NamedTuple):
    """The tables of all patterns of one length, in words."""

    size: int
    block: int
    #: Different blocks in ascending order, and the least distance from each to the end of a pattern.
    blocks: np.ndarray
    shift: np.ndarray
    #: Hashes of suffix and first block in ascending order, and the place of each pattern's first word.
    buckets: np.ndarray
    starts: np.ndarray


class Patterns:
    """Shift tables and suffix buckets of some items, one pair for each pattern length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int) -> None:
        words = [alnum_words(text) for _, text in items]
        self.ids: dict[bytes, int] = {}
        self.words = np.fromiter((self.ids.setdefault(w, len(self.ids)) for w in chain.from_iterable(words)), np.int32)
        lengths = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(lengths) - lengths
        self.names = [item for item, _ in items]
        self.groups = [self._group(size, self._starts(lengths, size, window)) for size in sorted({min(window, n) for n in lengths.tolist() if n})]

    def _starts(self, lengths: np.ndarray, size: int, window: int) -> np.ndarray:
        """First words of the patterns of ``size`` words."""
        own = (np.minimum(lengths, window) == size).nonzero()[0]
        many = lengths[own] - size + 1
        return np.repeat(self.first[own] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))

    def keys(self, words: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
        """A number for the block that ends before each place of ``at``; -1 where one of its words is in no item."""
        last = words[at - 1].astype(np.int64)
        if block == 1:
            return last
        before = words[at - 2].astype(np.int64)
        return np.where((last < 0) | (before < 0), -1, before * len(self.ids) + last)

    def _bucket(self, words: np.ndarray, ends: np.ndarray, size: int, block: int) -> np.ndarray:
        suffix, first = self.keys(words, ends, block).astype(np.uint64), self.keys(words, ends - size + block, block).astype(np.uint64)
        return (suffix * _MIX) ^ first

    def _group(self, size: int, starts: np.ndarray) -> Group:
        block = min(2, size)
        # the nearest window end at or behind a block that ends before word e of its item is word max(e, size)
        own = np.unique(np.searchsorted(self.first, starts, "right") - 1)
        lengths = np.append(self.first, len(self.words))[own + 1] - self.first[own]
        many = lengths - block + 1
        local = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + block
        keys = self.keys(self.words, np.repeat(self.first[own], many) + local, block)
        far = np.maximum(0, size - local)
        order = np.lexsort((far, keys))
        keys, far = keys[order], far[order]
        least = np.append(True, keys[1:] != keys[:-1])
        buckets = self._bucket(self.words, starts + size, size, block)
        order = np.argsort(buckets, kind="stable")
        return Group(size, block, keys[least], far[least].astype(np.uint8), buckets[order], starts[order].astype(np.int32 if len(self.words) < 1 << 31 else np.int64))

    def _shifts(self, group: Group, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The shift of the block at each end; one more than the largest where no pattern holds it."""
        keys = self.keys(words, ends, group.block)
        out = np.full(len(ends), group.size - group.block + 1, np.int64)
        known = (keys >= 0).nonzero()[0]
        at = np.minimum(np.searchsorted(group.blocks, keys[known]), len(group.blocks) - 1)
        same = group.blocks[at] == keys[known]
        out[known[same]] = group.shift[at[same]]
        return out

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and item number of all occurrences in an array of word numbers (-1: in no item)."""
        found = [(np.zeros(0, np.int64),) * 3]
        for g in self.groups:
            step = g.size - g.block + 1
            grid = np.arange(g.block, len(words) + 1, step)
            shift = self._shifts(g, words, grid)
            # a window that holds the block whole ends between its shift and step - 1 words behind it
            many = step - shift
            ends = np.repeat(grid + shift - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            ends = ends[(ends >= g.size) & (ends <= len(words))]
            ends = ends[self._shifts(g, words, ends) == 0]
            ends = ends[self.keys(words, ends - g.size + g.block, g.block) >= 0]
            hashed = self._bucket(words, ends, g.size, g.block)
            low, high = np.searchsorted(g.buckets, hashed, "left"), np.searchsorted(g.buckets, hashed, "right")
            for k in range(0, len(ends), 4096):  # candidates of some ends at once
                part = slice(k, k + 4096)
                many = high[part] - low[part]
                starts = np.repeat(ends[part] - g.size, many)
                own = g.starts[np.repeat(low[part] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
                equal = np.ones(len(starts), bool)
                for w in range(g.size):
                    equal &= words[starts + w] == self.words[own + w]
                starts, own = starts[equal], own[equal]
                found.append((starts, starts + g.size, np.searchsorted(self.first, own, "right") - 1))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def scan(self, texts: list[str | None]) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """For each text its number of words, and start, end and item number of its occurrences."""
        words = [alnum_words(t) for t in texts]
        n = np.array([len(w) for w in words], np.int64)
        # one number that no pattern holds between texts
        numbers = np.fromiter(map(self.ids.get, chain.from_iterable(chain(w, (None,)) for w in words), repeat(-1)), np.int32, int((n + 1).sum()))
        first = np.cumsum(n + 1) - (n + 1)
        start, end, item = self.search(numbers)
        order = np.argsort(start, kind="stable")
        start, end, item = start[order], end[order], item[order]
        cuts = np.searchsorted(start, np.append(first, len(numbers)))
        return n.tolist(), [(start[a:b] - f, end[a:b] - f, item[a:b]) for a, b, f in zip(cuts[:-1], cuts[1:], first, strict=True)]


def covered(starts: np.ndarray, ends: np.ndarray) -> int:
    """Positions inside at least one range; ranges are sorted by start."""
    if not len(starts):
        return 0
    before = np.concatenate([[0], np.maximum.accumulate(ends)[:-1]])
    return int(np.maximum(0, ends - np.maximum(starts, before)).sum())


def _result(ids: list, n_words: list, hits: list, items: list) -> dict:
    texts = [",".join(sorted(i for i in x if i is not None)) for x in items]
    n_hit = [covered(a, b) for a, b in hits]
    return {"doc_id": ids, "n_words": n_words, "n_hit": n_hit, "n_items": [len(x) for x in items], "items_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in texts], "contaminated": [x > 0 for x in n_hit]}


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): its words, how many lie inside an occurrence of a benchmark window, and the items.

    ``benchmark`` has item_id and text. A null or empty text has no words and no hits;
    repeated items and repeated documents keep their own rows; an empty benchmark
    contaminates nothing; columns beyond those named are ignored. Items with a null
    item_id count as one item, which the digest of the items leaves out.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    scans = []
    for k in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        scans.append(spark.sparkContext.broadcast(Patterns([(r.item, r.text) for r in own.toLocalIterator()], window)))
    if n == 1:

        def whole(batch: dict, given: Broadcast) -> dict:
            n_words, hits = given.value.scan(batch["text"])
            names = given.value.names
            return _result(batch["doc_id"], n_words, [(a, b) for a, b, _ in hits], [{names[i] for i in set(x.tolist())} for _, _, x in hits])

        return map_rows(docs, whole, RESULT, lambda given=scans[0]: given)

    def part(batch: dict, given: Broadcast) -> dict:
        n_words, hits = given.value.scan(batch["text"])
        names = given.value.names
        return {"row": batch["row"], "doc_id": batch["doc_id"], "n_words": n_words, "starts": [a for a, _, _ in hits], "ends": [b for _, b, _ in hits], "items": [[names[i] for i in set(x.tolist())] for _, _, x in hits]}

    def united(batch: dict) -> dict:
        order = [np.argsort(a, kind="stable") for a in batch["starts"]]
        hits = [(np.array(a, np.int64)[o], np.array(b, np.int64)[o]) for a, b, o in zip(batch["starts"], batch["ends"], order, strict=True)]
        return _result(batch["doc_id"], batch["n_words"], hits, [set(x) for x in batch["items"]])

    # equal rows have equal hits, so a row is known by its id and text; copies are told apart again by their number
    keyed = docs.withColumn("row", F.sha2(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))), 256))
    copies = keyed.groupBy("row").agg(F.count("*").alias("copies"))
    each = [map_rows(keyed, part, "row string, " + HITS, lambda given=given: given) for given in scans]
    flat = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")]
    all_hits = reduce(DataFrame.unionByName, each).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *flat)
    many = all_hits.join(copies, "row").withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return map_rows(many.select("doc_id", "n_words", "starts", "ends", "items"), united, RESULT)

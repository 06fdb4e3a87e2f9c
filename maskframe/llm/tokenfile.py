"""Token ids in files: frequency-ranked, byte-aligned variable-length codes with separate control bytes.

The texts are encoded with a ready tokenizer, every document ends with ``end_id``, and
the documents are laid out in ascending doc_id order. Ids are replaced by their rank in
the counts over the whole corpus, so that the commonest 256 take one byte. A block
holds the ranks of some documents: two bits an id in the control bytes say how many
bytes it has in the data bytes. Reading looks up the four lengths of a control byte in
a table and gathers the data bytes with numpy. A block also says how many ids of its
bucket stand before it, so a document's place comes from the files alone.

The files are Parquet tables with one row a block, so any store that Spark reads and
writes will do. A table ``ranks`` beside the blocks turns ranks into ids again.

Layout: documents are dealt by ranges of doc_id, one range a partition; the bounds come
from a range partitioning of the doc_ids alone. Only compressed ids are shuffled, never
texts.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Pieces
from .common import drop_dir, map_rows, shared_dir

BLOCK = "bucket int, before long, n_ids long, doc_ids binary, sizes binary, control binary, data binary"
#: Pieces of text that a worker keeps with their ids.
TABLE = 600_000
#: Ids after which a block is closed.
BLOCK_IDS = 1 << 18

_BLOCK = pa.schema({"bucket": pa.int32(), "before": pa.int64(), "n_ids": pa.int64(), "doc_ids": pa.binary(), "sizes": pa.binary(), "control": pa.binary(), "data": pa.binary()})
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes (two bits a value: its bytes less one) and data bytes (little-endian) of unsigned 32-bit values."""
    v = values.astype(np.uint32)
    size = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    at = np.cumsum(size) - size
    data = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max()) if len(v) else 0):
        has = size > k
        data[at[has] + k] = v[has] >> 8 * k & 0xFF
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of :func:`pack`."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)
    at = np.cumsum(size) - size
    out = raw[at].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, int(size.max()) if n else 0):
        has = size > k
        out[has] |= raw[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


#: Words of letters of ASCII and Latin-1 only: nothing to compose, one word each in the split expression.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


class LibraryEncoder:
    """Ids of pieces of text from the tokenizers library.

    Pieces that are one word of Latin letters skip the library's normalizer and split
    expression, which would leave them as they are but for lower case: they go to the same
    model, many in one text with blanks between, and the end-of-word tokens say where each
    ends. All other pieces go through the whole tokenizer one by one.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.dtype = "<u2" if self.size <= 1 << 16 else "<u4"
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        plain, other = [], []
        for p in pieces:
            (plain if LETTERS.fullmatch(p) else other).append(p)
        ids: dict[bytes, bytes] = {}
        if plain:
            # one text a thousand words: as many end-of-word tokens as words, and each word ends with one
            texts = [b" ".join(plain[k : k + 1000]).decode().lower() for k in range(0, len(plain), 1000)]
            # few texts at once: the library's encodings hold much more than ids
            got = np.concatenate([np.array(e.ids, self.dtype) for k in range(0, len(texts), 8) for e in self.words.encode_batch_fast(texts[k : k + 8], add_special_tokens=False)])
            packed, width = got.tobytes(), got.itemsize
            ends = ((np.flatnonzero(self.ends[got]) + 1) * width).tolist()
            ids = {p: packed[a:b] for p, a, b in zip(plain, [0, *ends[:-1]], ends, strict=True)}
        for k in range(0, len(other), 4000):
            some = other[k : k + 4000]
            made = self.tokenizer.encode_batch_fast([p.decode("utf-8", "surrogatepass") for p in some], add_special_tokens=False)
            ids.update(zip(some, (np.array(e.ids, self.dtype).tobytes() for e in made), strict=True))
        return [ids[p] for p in pieces]


@functools.lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    """The tokenizer and its table of pieces, made once a worker."""
    library = LibraryEncoder(path)
    return Pieces(library, library.dtype, TABLE)


def _encoded(docs: DataFrame, path: str, end_id: int, bounds: list[int]) -> DataFrame:
    def setup() -> tuple:
        pieces = _pieces(path)
        return pieces, np.array([end_id], pieces.dtype).tobytes(), zstandard.ZstdCompressor(level=1), np.array(bounds, np.int64)

    def rows(batch: dict, state: tuple) -> dict:
        pieces, end, zstd, cuts = state
        ids = [x + end for x in pieces.texts(batch["text"])]
        at = np.searchsorted(cuts, np.array([-(1 << 63) if d is None else d for d in batch["doc_id"]], np.int64), side="left")
        return {"bucket": at.astype(np.int32), "doc_id": batch["doc_id"], "wide": [pieces.dtype.itemsize == 4] * len(ids), "ids": [zstd.compress(x) for x in ids]}

    return map_rows(docs, rows, "bucket int, doc_id long, wide boolean, ids binary", setup)


RAW = "bucket int, before long, n_ids long, doc_ids binary, sizes binary, wide boolean, ids binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents sorted by bucket as blocks of raw ids; a task has whole buckets, so it knows what stands before each block."""
    zstd, unzstd = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    held: list[tuple[int | None, bytes]] = []
    bucket, wide, size, before = None, False, 0, 0

    def block() -> pa.RecordBatch:
        valid = np.array([d is not None for d, _ in held])
        keys = np.array([0 if d is None else d for d, _ in held], "<i8").tobytes() + valid.astype(np.uint8).tobytes()
        sizes = np.array([len(x) // (4 if wide else 2) for _, x in held], "<u4")
        row = {"bucket": pa.array([bucket], pa.int32()), "before": [before], "n_ids": [size], "doc_ids": [keys], "sizes": [sizes.tobytes()], "wide": [wide], "ids": [zstd.compress(b"".join(x for _, x in held))]}
        return pa.RecordBatch.from_pydict(row)

    for b in batches:
        for own, doc, wide, packed in zip(*(b[c].to_pylist() for c in ("bucket", "doc_id", "wide", "ids")), strict=True):  # noqa: B007
            if held and (own != bucket or size >= BLOCK_IDS):
                yield block()
                before = before + size if own == bucket else 0
                held, size = [], 0
            bucket = own
            held.append((doc, unzstd.decompress(packed)))
            size += len(held[-1][1]) // (4 if wide else 2)
    if held:
        yield block()


def _raw(packed: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<u4" if wide else "<u2")


def _counts(coded: DataFrame) -> DataFrame:
    """Occurrences of each id over all documents; a task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for packed, wide in zip(b["ids"].to_pylist(), b["wide"].to_pylist(), strict=True):
                more = np.bincount(_raw(packed, wide))
                if len(more) > len(total):
                    total, more = more, total
                total[: len(more)] += more
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(used.astype(np.int64)), "n": pa.array(total[used])})

    return coded.select("wide", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _bounds(docs: DataFrame, n: int) -> list[int]:
    """The largest doc_id of each of ``n`` ranges of about equal size but the last one; one row a range is collected."""
    ranged = docs.select("doc_id").where("doc_id IS NOT NULL").repartitionByRange(n, "doc_id")
    tops = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.max("doc_id").alias("top")).collect()
    return sorted(r.top for r in tops)[:-1]


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int = 2) -> None:
    """Write the ids of ``docs`` (doc_id, text) under ``out``: tables ``blocks`` and ``ranks``.

    A null or empty text has the end id only. Rows of equal doc_id stand side by side,
    ordered by their compressed ids; a null doc_id comes first. An empty table gives
    empty tables; further columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded_at = shared_dir(spark)
    dealt = _encoded(docs, path, end_id, _bounds(docs, n)).repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "ids")
    dealt.mapInArrow(_blocks, RAW).write.option("compression", "none").parquet(coded_at)  # the ids are compressed already
    coded = spark.read.parquet(coded_at)
    ranked = [r.id for r in _counts(coded).orderBy(F.desc("n"), "id").collect()]  # as many as the vocabulary has, at most
    spark.createDataFrame([(k, i) for k, i in enumerate(ranked)], "rank int, id int").coalesce(1).write.parquet(f"{out}/ranks")
    table = spark.sparkContext.broadcast(np.array(ranked, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.zeros(int(table.value.max()) + 1 if len(table.value) else 1, np.uint32)
        rank[table.value] = np.arange(len(table.value))
        for b in batches:
            for row in b.to_pylist():
                control, data = pack(rank[_raw(row.pop("ids"), row.pop("wide"))])
                yield pa.RecordBatch.from_pylist([row | {"control": control, "data": data}], schema=_BLOCK)

    coded.mapInArrow(run, BLOCK).write.option("compression", "zstd").parquet(f"{out}/blocks")
    drop_dir(spark, coded_at)


def read_tokens(spark: SparkSession, out: str, each: str = "ids array<int>") -> DataFrame:
    """doc_id, start, n_tokens and, from the files under ``out``, the ids of each document or only their CRC (``each``: "ids array<int>" or "ids_crc32 long").

    start is the number of ids that the files hold before the document, in their order:
    by doc_id, null first, and as written where doc_ids are equal.
    """
    ranked = [r.id for r in spark.read.parquet(f"{out}/ranks").orderBy("rank").collect()]  # bounded by the vocabulary
    blocks = spark.read.parquet(f"{out}/blocks")
    total, base = 0, {}
    for r in sorted(blocks.groupBy("bucket").agg(F.sum("n_ids").alias("n")).collect(), key=lambda r: r.bucket):  # one row a partition of the layout
        base[r.bucket] = total
        total += r.n
    table = spark.sparkContext.broadcast((np.array(ranked, np.uint32), base))
    column = each.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, bases = table.value
        for b in batches:
            for row in b.to_pylist():
                sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
                ids = ranks[unpack(row["control"], row["data"], int(sizes.sum()))]
                ends = np.cumsum(sizes)
                cuts = ends.tolist()
                keys = np.frombuffer(row["doc_ids"][: 8 * len(sizes)], "<i8")
                missing = np.frombuffer(row["doc_ids"][8 * len(sizes) :], np.uint8) == 0
                if column == "ids_crc32":
                    raw = memoryview(ids.astype("<u4").tobytes())
                    made = pa.array([zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip([0, *cuts], cuts, strict=False)], pa.int64())
                else:
                    made = pa.ListArray.from_arrays(pa.array([0, *cuts], pa.int32()), pa.array(ids.astype(np.int32)))
                start = ends - sizes + (bases[row["bucket"]] + row["before"])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64(), mask=missing), "start": pa.array(start), "n_tokens": pa.array(sizes), column: made})

    return blocks.mapInArrow(run, f"doc_id long, start long, n_tokens long, {each}")

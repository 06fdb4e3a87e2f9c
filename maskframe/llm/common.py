"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words where a contract says ``[^\x20\x09-\x0D]+``.
SPACE = r"\x20\x09-\x0D"

#: Folders made inside each open :func:`scratch` block.
_MADE: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``.

    Where that setting is absent, a local session makes its own folder; a cluster
    session must name one, as executors can't see the driver's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="maskframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/maskframe-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, the folders that :func:`shared_dir` made inside the block: for callers that have written their result by then."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield
    finally:
        _MADE[:] = [m for m in _MADE if m is not made]  # by identity: nested blocks may hold equal lists
        for path in made:
            drop_dir(spark, path)


#: For tables whose rows hold megabytes: row groups of some of them, as a reader holds a row group at once.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def stored(df: DataFrame, compression: str = "zstd", **options: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.options(compression=compression, **options).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def drop_stored(df: DataFrame) -> None:
    """Delete what :func:`stored` wrote for ``df``, once nothing reads it any more."""
    drop_dir(df.sparkSession, df._stored_at)


def with_keys(docs: DataFrame, repeated: bool = True) -> tuple[DataFrame, int]:
    """``docs`` as _key, a number of the row's own that isn't null, and doc, a struct of all its columns; and the largest doc_id.

    _key is the doc_id; rows without one (and, where ``repeated``, all but one of the
    rows that share one) get numbers beyond the largest doc_id. Only such rows are stored.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("_key"), F.struct(*docs.columns).alias("doc"))
    top, nulls = keyed.agg(F.coalesce(F.max("_key"), F.lit(0)), F.count_if(F.col("_key").isNull())).first()
    top = max(top, 0)
    odd = keyed.where("_key IS NULL") if nulls else keyed.where("false")
    if repeated:
        shared = stored(keyed.where("_key IS NOT NULL").groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select("_key"))
        if shared.limit(1).count():
            odd = odd.unionByName(keyed.join(shared, "_key", "left_semi"))
            keyed, nulls = keyed.where("_key IS NOT NULL").join(shared, "_key", "left_anti"), nulls + 1
    if not nulls:
        return keyed, top
    if top >= 1 << 62:
        raise ValueError("rows without a doc_id of their own need doc_ids below 2^62")
    odd = stored(odd.withColumn("_row", F.monotonically_increasing_id()))
    first = odd.where("_key IS NOT NULL").groupBy("_key").agg(F.min("_row").alias("_first"))
    own = F.when(F.col("_row") == F.col("_first"), F.col("_key")).otherwise(F.col("_row") + F.lit(top + 1))
    numbered = odd.join(first, "_key", "left").withColumn("_key", own).select("_key", "doc")
    return keyed.where("_key IS NOT NULL").unionByName(numbered), top


#: Parts that the rows of one key are spread over in joins with a smaller side.
SALT = 16


def salted(df: DataFrame, by: str) -> DataFrame:
    """``df`` with a part number (``salt``) from the hash of ``by``: the side of a join where one key may have many rows."""
    return df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALT)))


def spread(df: DataFrame) -> DataFrame:
    """Each row of ``df`` once for every part of :func:`salted`: the smaller side of the join."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))


#: A key with more rows than this and than its share of all rows is heavy; there are at most ``HEAVY_KEYS`` of them.
HEAVY_ROWS, HEAVY_KEYS = 1000, 50_000


def meet(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined by ``key`` with ``table``, whose column n says how many of the ``total`` rows have its key; n is dropped.

    Rows of heavy keys stay where they are and meet theirs by a broadcast, which is small
    whatever the input; all others are shuffled, no key of them being large.
    """
    most = max(HEAVY_ROWS, total // HEAVY_KEYS)
    heavy = F.broadcast(table.where(F.col("n") > most).drop("n"))
    light = table.where(F.col("n") <= most).drop("n")
    names = F.broadcast(table.where(F.col("n") > most).select(key).distinct())
    return rows.join(heavy, key).unionByName(rows.join(names, key, "left_anti").join(light, key))


def map_rows(df: DataFrame, rows: Callable[[dict], Iterator[dict] | dict], schema: str, setup: Callable | None = None) -> DataFrame:
    """``rows`` over whole Arrow batches as dicts of lists; ``setup`` runs once a task and its result is the second argument."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            got = batch.to_pydict()
            made = rows(got, state) if setup else rows(got)
            yield pa.RecordBatch.from_pydict({f.name: pa.array(made[f.name], f.type) for f in out}, schema=out)

    return df.mapInArrow(run, schema)


_NOT_WORD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_NOT_WORD).split()


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()

"""Helpers shared by the training-data operators: shared storage, Arrow passes, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch: documents may be long, so batches are kept small.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def session(df: DataFrame) -> SparkSession:
    """The session of *df*, with Arrow batches small enough for long texts (lower settings stay as they are)."""
    spark = df.sparkSession
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent (tests, one machine) a temporary folder becomes it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext.getCheckpointDir()
        base = found or "file://" + tempfile.mkdtemp(prefix="sparkrel-")
        if not found:
            spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write *df* into the shared folder and read it back: its lineage ends there."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(*frames: DataFrame) -> None:
    """Delete the files of stored() frames that nothing reads any more."""
    for df in frames:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        place = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def fresh(df: DataFrame, name: str) -> str:
    """*name*, with underscores added until no column of *df* is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def add_columns(df: DataFrame, fields: list[T.StructField], fn: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """Append columns computed from Arrow batches; every column of *df* passes through untouched.

    ``fn()`` is called once in each task and gives the function from a batch to the new arrays.
    """
    session(df)
    schema = T.StructType([*df.schema.fields, *fields])
    kinds = [_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = fn()
        for batch in batches:
            if batch.num_rows:
                new = [pa.array(x, k) if not isinstance(x, pa.Array) else x.cast(k) for x, k in zip(each(batch), kinds, strict=True)]
                names = [*batch.schema.names, *(f"_{i}" for i in range(len(new)))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    return df.mapInArrow(_renamed(run, schema.names), schema)


def map_batches(df: DataFrame, schema: str | T.StructType, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` with small batches."""
    session(df)
    return df.mapInArrow(fn, schema)


def _renamed(run, names):
    def renamed(batches):
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=names)

    return renamed


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in column(batch, name).to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, where=None) -> DataFrame:
    """doc_id, text and label (long) of at most *most* labelled documents, by the order of a hash of doc_id.

    Of several labels of a document the largest counts; null labels and ids are left out.  The ids are
    bounded by *most*, so they are broadcast, and the documents are not shuffled.
    """
    from pyspark.sql import functions as F

    rows = labels.select(F.col("doc_id"), F.col(label).cast("long").alias("label")).dropna()
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    if where is not None:
        rows = rows.where(where)
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit(label)), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 when divided by 3."""
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Memo(dict):
    """Values of words by a function, for at most twice *most* words: those in use when it fills stay once more.

    It is made in a task and ends with it; an entry of a usual word takes some 200 bytes, longer ones are not kept.
    """

    LONG = 64

    def __init__(self, of: Callable, most: int = 150_000) -> None:
        self.of, self.most, self.old = of, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.of(key)
            if len(key) > self.LONG:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

"""What the operators share: the cluster's shared folder, whitespace words, size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the five ASCII controls \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join is broadcast only if it was counted and has at most so many rows.
BROADCAST_ROWS = 100_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else (local sessions only) a temporary one; an error on a cluster without it."""
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if held:
        return held
    live = spark.sparkContext._jsc.sc().getCheckpointDir()
    if live.isDefined():
        return live.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(root)
    return root


class Scratch:
    """Tables in the shared folder that cut lineage; they outlive a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """df, written once as Parquet and read again."""
        path = self.path(name)
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidemark_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of this scratch that nothing lazy reads any more."""
        path = getattr(df, "_tidemark_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def hint_if_small(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most bound rows (counted here unless given); else unchanged, for a shuffled join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= bound else df


def packed(docs: DataFrame) -> Column:
    """Whole rows in one struct named row, so that no name of theirs clashes with an operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def words(text: Column) -> Column:
    """The text's words in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Count of words: the pieces between spaces, less an empty first and last one."""
    space = r"^[\x20\x09-\x0D]"
    text = F.coalesce(text, F.lit(""))
    pieces = F.size(F.split(text, r"[\x20\x09-\x0D]+"))
    ends = F.when(text.rlike(space), 1).otherwise(0) + F.when(F.substring(text, -1, 1).rlike(space), 1).otherwise(0)
    return F.greatest(F.when(text == "", 0).otherwise(pieces - ends), F.lit(0)).cast("long")


def small_batches(batches: Iterator[pa.RecordBatch], column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most `most` bytes of one text column (a single longer row stands alone), so that memory is bounded by bytes, not rows."""
    for b in batches:
        col = b.column(column)
        if col.nbytes <= most:
            yield b
            continue
        start, held = 0, 0
        lengths = [0 if x is None else x for x in pa.compute.binary_length(col).to_pylist()]
        for i, n in enumerate(lengths):
            if held and held + n > most:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < b.num_rows:
            yield b.slice(start)


def pieces(data: bytes, most: int = 4 << 20) -> Iterator[bytes]:
    """data in pieces of `most` bytes or a little more, each up to a space (a longer run without one stays whole)."""
    at = 0
    while len(data) - at > most and (cut := data.find(b" ", at + most)) >= 0:
        yield data[at:cut]
        at = cut
    yield data[at:]

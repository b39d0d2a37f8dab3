"""What the corpus operators share: cut lineage, bounded slices of Arrow batches, checked names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space of the word definition: U+0020 and U+0009 to U+000D.
SPACE = "\\x20\\x09-\\x0D"
MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of our own only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        made = spark.sparkContext.getCheckpointDir()
        if made is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewell-"))
            made = spark.sparkContext.getCheckpointDir()
        named = made
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there and lost executors lose nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Removes what materialize wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words, without building an array of them: each word and the space before it shrink to one sign."""
    shrunk = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]*+[^{SPACE}]++", "x")
    return F.length(F.regexp_replace(shrunk, f"[{SPACE}]++$", "")).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def slices(batches: Iterable[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about limit bytes of one column, so that a worker's memory doesn't depend on the batch; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < len(sizes):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


HOT = 1000


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that df doesn't have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def skew_join(left: DataFrame, right: DataFrame, key: str, rows: Column, total: int, how: str = "left") -> DataFrame:
    """left joined to right, which has one row for each key and knows the key's number of left rows (`rows`).

    Keys with more than total / HOT rows are fewer than HOT, and so broadcast; no other key can fill a task.
    """
    most = total // HOT + 1
    hot, cold = right.where(rows > most), right.where(rows <= most)
    own = [c for c in right.columns if c != key]
    flagged = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    first = flagged.where("_hot").drop("_hot")
    rest = flagged.where("_hot IS NULL").drop("_hot", *own).join(cold, key, how)
    return first.unionByName(rest)

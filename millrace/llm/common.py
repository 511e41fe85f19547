"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract of this subpackage: space, tab, line feed to carriage return.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    It is spark.checkpoint.dir. Only where that is unset and all runs in one process (tests) a temporary folder is
    taken; on a cluster that raises ValueError, as executors wouldn't share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: a folder that driver and executors share is needed")
        base = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


_MADE: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; clean_up() deletes what is there."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


@atexit.register
def clean_up() -> None:
    """Deletes all folders of this process's operators. To be called when no result is read any more; else the end of the process does it."""
    while _MADE:
        try:
            files, path = fs.FileSystem.from_uri(_MADE.pop())
            if files.get_file_info(path).type == fs.FileType.Directory:
                files.delete_dir(path)
        except (OSError, ValueError):
            continue  # a file system that only Spark's readers know, or that is gone


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed now and read from the shared folder: lineage ends there, lost executors lose nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again (columnar and compressed, unlike a checkpoint)."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows (of a few longs) that may be broadcast once their number is known: at most about 50 MB.
BROADCAST_ROWS = 1_000_000
#: A key is hot if it has over one in HOT_SHARE of all rows (so there are at most HOT_SHARE such keys), and over HOT_LEAST.
HOT_SHARE, HOT_LEAST = 1000, 1000
#: Up to so many rows all may have one key: one task joins them.
FEW_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, name: str) -> DataFrame:
    """df written, and marked for a broadcast if it has at most BROADCAST_ROWS rows; a larger one is left to a shuffle."""
    kept = written(df, name)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def join_with_hot_keys(many: DataFrame, one: DataFrame, key: str, rows: str, total: int, by: str) -> DataFrame:
    """many joined with one on key; `one` has one row a key and in column `rows` how many rows of `many` (in all: total) have it.

    Rows of a hot key are dealt out by a hash of their column `by` over as many parts as there are shares of
    total / HOT_SHARE in them, and its row of `one` goes to each part: at most 2 * HOT_SHARE rows more. Only the hot
    keys and their numbers of parts are broadcast, HOT_SHARE rows at most. Up to FEW_ROWS rows this is a plain join,
    with the same result.
    """
    if total <= FEW_ROWS:
        return many.join(one.drop(rows), key)
    hot = (F.col(rows) > HOT_LEAST) & (F.col(rows) * HOT_SHARE > total)
    parts = F.when(hot, F.ceil(F.col(rows) * HOT_SHARE / total).cast("int")).otherwise(F.lit(1))
    few = one.where(hot).select(key, parts.alias("__mr_parts"))
    dealt = many.join(F.broadcast(few), key, "left").withColumn("__mr_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("__mr_parts")), F.lit(0)).cast("int")).drop("__mr_parts")
    copies = one.withColumn("__mr_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop(rows)
    return dealt.join(copies, [key, "__mr_part"]).drop("__mr_part")


def give_back_memory() -> None:
    """Free memory that this worker still holds from other tasks goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def whole_groups(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """The columns of a partition that is sorted by its first, a long, in parts of about `least` rows that hold whole groups."""
    held: list[list[np.ndarray]] = []
    n, wanted = 0, least
    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        n += b.num_rows
        if n >= wanted:
            joined = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(joined[0], joined[0][-1]))
            if cut:
                yield [x[:cut] for x in joined]
            held, n = [[x[cut:] for x in joined]], n - cut
            wanted = max(least, 2 * n)
    if n:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def text_blocks(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[tuple[list, list]]:
    """(doc_ids, texts) in blocks of about `limit` characters; batches have doc_id and text first. Null texts stay None."""
    ids: list = []
    texts: list = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = t.as_py()
            ids.append(i)
            texts.append(t)
            size += len(t) if t else 1
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def doc_text(docs: DataFrame) -> DataFrame:
    """The two columns that most operators read."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

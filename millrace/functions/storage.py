"""The folder that driver and executors share, and Spark ML models as bytes by way of it."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below spark.checkpoint.dir. Where that is unset, below a temporary folder if all runs in one process;
    on a cluster ValueError, as executors wouldn't share it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: a folder that driver and executors share is needed")
        base = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


_MADE: list[str] = []


@atexit.register
def clean_up() -> None:
    """Deletes all paths that shared_folder() gave. To be called when no result is read any more; else the end of the process does it."""
    while _MADE:
        try:
            files, path = filesystem(_MADE.pop())
            if files.get_file_info(path).type == fs.FileType.Directory:
                files.delete_dir(path)
        except (OSError, ValueError):
            continue  # a file system that only Spark's readers know, or that is gone


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: what was drawn at random stays, also when an executor is lost."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def model_bytes(spark: SparkSession, model) -> bytes:
    """A fitted Spark ML stage or pipeline as a ZIP of its saved folder."""
    uri = shared_folder(spark)
    model.write().save(uri)
    files, root = fs.FileSystem.from_uri(uri)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files.get_file_info(fs.FileSelector(root, recursive=True)):
            if f.type == fs.FileType.File:
                with files.open_input_stream(f.path) as s:
                    z.writestr(f.path[len(root) + 1 :], s.read())
    files.delete_dir(root)
    return out.getvalue()


def model_from_bytes(spark: SparkSession, raw: bytes):
    """The model that model_bytes() saved."""
    from pyspark.ml import PipelineModel

    uri = shared_folder(spark)
    files, root = fs.FileSystem.from_uri(uri)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for name in z.namelist():
            files.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
            with files.open_output_stream(f"{root}/{name}") as s:
                s.write(z.read(name))
    return PipelineModel.load(uri)

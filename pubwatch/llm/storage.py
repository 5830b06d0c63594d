"""Files of the shared checkpoint folder that Python tasks write and read."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

from pubwatch.session import checkpoint_folder


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder for ``label`` below the shared checkpoint folder, as a URI or path."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def mounted(uri: str) -> str:
    """The path of a folder that is mounted on all executors; other stores can't be memory-mapped."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"spark.checkpoint.dir must be a mounted folder (a path or file:), not {parts.scheme}:")
    return unquote(parts.path) if parts.scheme else uri


def open_store(uri: str):
    """(pyarrow file system, path in it): local, HDFS, S3 or GCS."""
    import pyarrow.fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem(), mounted(uri)
    return pyarrow.fs.FileSystem.from_uri(uri)


@contextmanager
def whole_file(uri: str) -> Iterator:
    """Write under another name, then rename: a reader never sees half a file, a repeated task overwrites it whole."""
    store, path = open_store(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    aside = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(aside, compression=None) as out:
        yield out
    store.move(aside, path)


def write_whole(uri: str, data: bytes | memoryview) -> None:
    with whole_file(uri) as out:
        out.write(data)


def release(*frames: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more; what lies elsewhere stays."""
    for df in frames:
        spark = df.sparkSession
        folder = urlparse(checkpoint_folder(spark)).path.rstrip("/") + "/"
        for parent in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            if unquote(urlparse(parent).path).startswith(folder):
                path = spark._jvm.org.apache.hadoop.fs.Path(unquote(parent))
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

"""Files of tasks in the shared folder, by any scheme that pyarrow opens."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs as pafs
from pyspark.sql import SparkSession

from lodestone.cluster import shared_dir


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own below the shared one."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, path = opened(folder)
    fs.create_dir(path)
    return folder


def remove_folder(folder: str) -> None:
    fs, path = opened(folder)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)


def mapped(uri: str, dtype: type = np.int64) -> np.ndarray:
    """A file of numbers, memory-mapped. One that is not mounted is fetched to a file that is unlinked at once."""
    fs, path = opened(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with tempfile.NamedTemporaryFile() as near, fs.open_input_stream(path) as far:
        while block := far.read(1 << 24):
            near.write(block)
        near.flush()
        return np.memmap(near.name, dtype, "r") if near.tell() else np.zeros(0, dtype)

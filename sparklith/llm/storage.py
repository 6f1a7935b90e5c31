"""Shared tables and files of the text operators, and how workers reach them."""

from __future__ import annotations

import mmap
import os
import sys
from collections import OrderedDict
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

from sparklith.sources import shared
from sparklith.sources.shared import release, released_shuffles, shared_root  # noqa: F401

#: Files that a worker has mapped at most, and bytes that it holds of them where they can't be mapped.
MAPS, HELD_BYTES = 16384, 1 << 28
_NO_HANDLE = {"trackfd": False} if sys.version_info >= (3, 13) else {}


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package from the place the driver imported it from."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


class Workspace(shared.Workspace):
    """A workspace of the text operators: workers can import this package."""

    def __init__(self, spark: SparkSession, name: str):
        ship_code(spark)
        super().__init__(spark, name)


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a shared folder, on the driver and on executors alike."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        path = uri.removeprefix("file:")
        return fs.LocalFileSystem(), "/" + path.lstrip("/") if path.startswith("/") else os.path.abspath(path)
    return fs.FileSystem.from_uri(uri)


def write_array(folder: str, name: str, *parts: np.ndarray) -> None:
    """Write under a name of this attempt's own, then rename: a task that runs again leaves the same file."""
    from pyspark import TaskContext

    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    temporary = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(temporary, compression=None) as out:
        for x in parts:
            out.write(np.ascontiguousarray(x).data)
    fs.move(temporary, f"{root}/{name}")


class Files:
    """Arrays of a shared folder, mapped at first use; those not asked for longest are let go beyond the bounds."""

    def __init__(self, folder: str, maps: int = MAPS, held: int = HELD_BYTES):
        self.fs, self.root = filesystem(folder)
        self.maps, self.held, self.size = maps, held, 0
        self.open: OrderedDict[str, bytes | mmap.mmap] = OrderedDict()

    def _load(self, name: str) -> bytes | mmap.mmap:
        from pyarrow import fs as pafs

        if isinstance(self.fs, pafs.LocalFileSystem):
            with open(f"{self.root}/{name}", "rb") as f:
                return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **_NO_HANDLE) if os.fstat(f.fileno()).st_size else b""
        with self.fs.open_input_file(f"{self.root}/{name}") as f:  # a store that can't be mapped
            out = f.read()
        self.size += len(out)
        return out

    def raw(self, name: str) -> bytes | mmap.mmap:
        if name in self.open:
            self.open.move_to_end(name)
        else:
            self.open[name] = self._load(name)
            while len(self.open) > self.maps or (self.size > self.held and len(self.open) > 1):
                _, old = self.open.popitem(last=False)
                self.size -= len(old) if isinstance(old, bytes) else 0
        return self.open[name]

    def array(self, name: str, shard: int, dtype: str) -> np.ndarray:
        return np.frombuffer(self.raw(f"{name}-{shard:06d}"), dtype)

"""Shared workspace: intermediate tables and files that every executor and the driver can see.

What an operator returns may still read its workspace, so a workspace lasts until :meth:`Workspace.drop`, :func:`release`
or the end of the driver.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_LIVE: dict[str, Workspace] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, a folder of our own: on one machine alone (a ``local`` master, as in tests). On a cluster it is
    an error, as no executor would see another one's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if (set_ := context._jsc.sc().getCheckpointDir()).isDefined():
            root = set_.get()
        elif not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            if not _OWN:
                _OWN.append(tempfile.mkdtemp(prefix="sparklith-"))
            root = "file://" + _OWN[0]
    return root.rstrip("/")


def live() -> set[str]:
    """The paths of all workspaces of this driver."""
    return set(_LIVE)


def release(but: set[str] = frozenset()) -> None:
    """Delete all workspaces of this driver but those named. Tables that a query returned can't be read any more."""
    for path in set(_LIVE) - set(but):
        _LIVE[path].drop()


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # the driver's JVM may be gone by now
        _LIVE.clear()
    for root in _OWN:
        if os.path.isdir(root) and not os.listdir(root):
            os.rmdir(root)


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run within remove their shuffle files at their end, not when the driver happens to collect garbage.

    A table that was written is never computed again, so nothing asks for them. The session's own setting comes back.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Workspace:
    """A fresh folder below the shared root; tables in it cut the lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        _LIVE[self.path] = self

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return the table that was written."""
        path = f"{self.path}/{name}"
        with released_shuffles(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete one table, or everything; nothing that is still to be computed may read it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        if not name:
            _LIVE.pop(self.path, None)

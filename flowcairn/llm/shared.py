"""Helpers shared by the corpus operators: intermediate tables, file systems and worker state."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid

from pyspark.sql import DataFrame, SparkSession

from flowcairn.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later stages never recompute it."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def open_store(uri: str):
    """Arrow file system and path of a folder; works for local paths and for the stores Arrow knows."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def give_back_memory() -> None:
    """Return what finished batches have left in Arrow's pool and the C library to the system."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def lean(name: str, run):
    """A task function that drops other operators' caches before and spare memory after its partition."""

    def task(batches):
        worker_state(name)
        try:
            yield from run(batches)
        finally:
            give_back_memory()

    return task


def worker_state(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, so tasks of one operator share caches.

    A worker serves one operator at a time: what others left behind is dropped, to give memory back.
    """
    module = sys.modules.setdefault("_flowcairn_worker", types.ModuleType("_flowcairn_worker"))
    held = module.__dict__.setdefault("held", {})
    for other in [k for k in held if k != name]:
        held.pop(other).clear()
    return held.setdefault(name, {})

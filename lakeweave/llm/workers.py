"""Python workers, which outlive their tasks: what they keep from task to task, and memory that they give back."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def worker_state() -> types.ModuleType:
    """A module object that lives as long as the Python worker process, or for encoders until a ``lean`` task."""
    return sys.modules.setdefault("_lakeweave_worker_state", types.ModuleType("_lakeweave_worker_state"))


def give_back() -> None:
    """Returns freed memory to the system. The allocators keep it otherwise, so that a worker stays as large as the largest
    moment of any task that it ever ran."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(run: Callable, keep: bool = False) -> Callable:
    """The Arrow function ``run``, whose tasks leave a worker small: they first drop the encoders that tokenizing tasks kept
    (unless ``keep``: those tasks themselves) and give back what they freed once they end."""

    @wraps(run)
    def leaving(batches) -> Iterator[pa.RecordBatch]:
        if not keep:
            worker_state().__dict__.pop("encoders", None)
        try:
            yield from run(batches)
        finally:
            give_back()

    return leaving

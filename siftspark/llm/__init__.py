"""Operators for preparing training data; nothing else in the library imports them.

A Python worker that Spark keeps for later tasks collects garbage after each; then it also hands back to the system what
it has freed, which the allocators of C and Arrow would keep: some 100 to 200 MB a worker, beside those that work.
"""

import ctypes
import gc
import os

import pyarrow as pa


def hand_back(phase: str, info: dict) -> None:
    """After a full collection: memory that is free, but held by Arrow's pool and by malloc, goes back to the system."""
    if phase == "stop" and info["generation"] == 2:
        pa.default_memory_pool().release_unused()
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)


libc = ctypes.CDLL(None)
if "SPARK_REUSE_WORKER" in os.environ and hand_back not in gc.callbacks:
    gc.callbacks.append(hand_back)

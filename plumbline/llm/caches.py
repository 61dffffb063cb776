"""Caches of a Python worker, which Spark uses again for other operators."""

import ctypes
import gc
import sys

import pyarrow as pa

_WHERE = {"tokens": ("plumbline.llm.tokens", "_CACHES"), "words": ("plumbline.llm.words", "_HASHES"), "quality": ("plumbline.llm.quality", "_WORDS")}


def only(kind: str) -> None:
    """Empty the caches of all kinds but one, so that a worker holds those of one operator at a time, and give their memory back."""
    emptied = False
    for other, (module, name) in _WHERE.items():
        if other != kind and (found := sys.modules.get(module)) is not None and getattr(found, name):
            getattr(found, name).clear()
            emptied = True
    if emptied:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            return

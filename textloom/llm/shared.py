"""Things that each worker makes once from bytes of a bounded size sent by the driver."""

from __future__ import annotations

import ctypes
import hashlib
import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession

#: At most so many made things stay in a worker, those used last. No operator uses more than ``CHAIN`` of them in one pass.
KEEP, CHAIN = 6, 4
_made: dict[str, object] = {}


def clear() -> None:
    """Lets go of what other operators made in this worker, for one that needs the room."""
    _made.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what is freed
        trim(0)


class Shared:
    """``Shared(spark, make, *args).get()`` is ``make(*args)`` in any worker; args travel once to each executor.

    What is made is known by its arguments' content: operators that share a vocabulary, and later jobs, share it in a worker.
    """

    def __init__(self, spark: SparkSession, make: Callable, *args):
        self.key, self.make = f"{make.__qualname__}-{hashlib.sha256(pickle.dumps(args)).hexdigest()}", make
        self.args = spark.sparkContext.broadcast(args)

    def get(self):
        made = _made.pop(self.key, None)
        if made is None:
            while len(_made) >= KEEP:
                _made.pop(next(iter(_made)))
            made = self.make(*self.args.value)
        _made[self.key] = made  # the last one used is the last one to go
        return made


def read_file(path: str) -> bytes:
    """A vocabulary file, read on the driver (some MB at most, whatever the corpus is)."""
    with open(path, "rb") as f:
        return f.read()

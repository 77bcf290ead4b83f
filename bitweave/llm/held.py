"""What a Python worker keeps between tasks: one object at a time.

Workers outlive stages. A stage's model, tokenizer or table is built once a worker and kept for its next tasks; when
another stage comes by, the old one goes and its memory is handed back.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_slot: dict[Hashable, Any] = {}


def held(key: Hashable, build: Callable[[], Any]) -> Any:
    if key not in _slot:
        let_go()
        _slot[key] = build()
    return _slot[key]


def let_go() -> None:
    """Drops what is kept."""
    if _slot:
        _slot.clear()
        give_back()


def give_back() -> None:
    """Frees what allocators hold on to."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(df):
    """Rows of whole texts go to Python in batches of at most BATCH_ROWS, so that a task holds few megabytes of them.

    Sets the session's batch size, unless it is lower already. Returns ``df``.
    """
    spark = df.sparkSession
    now = int(spark.conf.get(_BATCH, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return df

"""A keyed cache of persisted corpora under a byte budget.

A corpus that is in use (leased or pinned) stays; others leave, least recently
used first, when room is needed.  A hit neither evaluates nor checks the rows
that were offered with it.
"""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..limits import InvalidInput


@dataclass
class _Entry:
    corpus: object
    bytes: int
    leases: int = 0
    pinned: bool = False


class Residency:
    def __init__(self, budget_bytes: int):
        self.budget_bytes = budget_bytes
        self._entries: OrderedDict[tuple, _Entry] = OrderedDict()
        self._lock = threading.RLock()

    @property
    def reserved_bytes(self) -> int:
        return sum(e.bytes for e in self._entries.values())

    @contextmanager
    def lease(self, spark: SparkSession, artifact: str, dimensions: int, count: int, rows: Callable[[], DataFrame]) -> Iterator[object]:
        """The resident corpus of this artifact and shape; rows() makes (id, v) of binary16 rows on a miss."""
        from ..operators.corpus import Corpus

        need = Corpus.build_memory(dimensions, count)
        if not need.resident_bytes:
            raise InvalidInput("a resident corpus has rows")
        key = (spark.sparkContext.applicationId, dimensions, count, artifact)
        with self._lock:
            entry = self._entries.get(key)
            if entry is None:
                self._make_room(need.peak_bytes)
                corpus = Corpus.build_half(rows(), dimensions, count=count).persist()
                entry = self._entries[key] = _Entry(corpus, need.resident_bytes)
            self._entries.move_to_end(key)
            entry.leases += 1
        try:
            yield entry.corpus
        finally:
            with self._lock:
                entry.leases -= 1

    def pin(self, corpus: object, pinned: bool = True) -> None:
        for e in self._entries.values():
            if e.corpus is corpus:
                e.pinned = pinned

    def _make_room(self, need: int) -> None:
        free = self.budget_bytes - self.reserved_bytes
        idle = [k for k, e in self._entries.items() if not e.leases and not e.pinned]
        if free + sum(self._entries[k].bytes for k in idle) < need:
            raise InvalidInput("the residency budget is too small")
        for k in idle:
            if free >= need:
                break
            e = self._entries.pop(k)
            e.corpus.unpersist()
            free += e.bytes

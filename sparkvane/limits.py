"""Bounds of the data model and the errors that guard them."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

# Fixed values of the data model.
MAX_DIMENSIONS = 16_384
MAX_ROWS = 1 << 30
MAX_K = 1024
MAX_BATCH = 256
MAX_ELEMENTS = 1 << 32  # components in one shard, update or gather
LANE = 128  # rows are padded to a multiple of this many components
PAGE_ROWS = 16_384
TILE_ROWS = 256
LOAD_CHUNK_BYTES = 4 << 20


class InvalidInput(ValueError):
    """An argument or a row outside the contract; nothing was changed."""


class Conflict(RuntimeError):
    """Another writer was first; nothing was changed, and the newest version can be tried again."""


class Busy(RuntimeError):
    """A prepared search has no free worker."""


def check_dimensions(dimensions: int) -> int:
    if not 1 <= dimensions <= MAX_DIMENSIONS:
        raise InvalidInput(f"dimensions must be 1..={MAX_DIMENSIONS}")
    return dimensions


def check_rows(count: int) -> int:
    if not 0 <= count <= MAX_ROWS:
        raise InvalidInput(f"rows must be at most {MAX_ROWS}")
    return count


def check_k(k: int) -> int:
    if not 1 <= k <= MAX_K:
        raise InvalidInput(f"k must be 1..={MAX_K}")
    return k


def query_norm(values: Sequence[float], dimensions: int) -> float:
    """The L2 norm of a valid vector, summed in order in double precision."""
    if len(values) != dimensions:
        raise InvalidInput(f"a vector has {len(values)} components, not {dimensions}")
    total = 0.0
    for x in values:
        if x is None or not math.isfinite(x):
            raise InvalidInput("a vector has a component that is not finite")
        total += float(x) * float(x)
    if total == 0 or not math.isfinite(total):
        raise InvalidInput("a vector has no direction")
    return math.sqrt(total)


def check_batch(queries: Sequence[Sequence[float]], dimensions: int, k: int) -> None:
    """k, then whole rows, then the batch size; norms come after exclusions."""
    check_k(k)
    if any(len(q) != dimensions for q in queries):
        raise InvalidInput(f"queries must have {dimensions} components each")
    if len(queries) > MAX_BATCH:
        raise InvalidInput(f"a batch has at most {MAX_BATCH} queries")


def check_excluded(excluded: Iterable[int], count: int) -> list[int]:
    out = sorted({int(i) for i in excluded})
    if out and not (0 <= out[0] and out[-1] < count):
        raise InvalidInput("excluded IDs must be rows of the corpus")
    return out


def padded(dimensions: int) -> int:
    return -(-dimensions // LANE) * LANE

"""Benchmark decontamination by q-gram counting and banded alignment.

A passage of m characters that occurs with at most k edits shares at least
m - q + 1 - k*q of its q-grams with the text, all within k + 1 neighbouring
diagonals (text position minus passage position).  Shared q-grams are counted
in bands of 2(k + 1) diagonals that overlap by half, so one band sees them all;
bands that reach the bound are aligned, inside the band only.

The benchmark is dealt with in blocks of a fixed size, broadcast, against all
documents; documents are never shuffled.  One pass over the documents takes
all blocks up to PASS_CHARS: for every Arrow batch a worker goes through the
blocks and holds the index of a few.  A larger benchmark takes further passes.

Pairs of equal q-grams are made a slice at a time, so a text and a passage that
repeat one gram (rulers, padding, tables) cost time, not memory.

Defined results: case is folded per character; null texts are empty; a null or
blank item matches nothing, one shorter than q characters without edits only;
where an item matches at several places the one with the fewest edits counts,
then the first.  Items without an id are not reported, but ``clean`` heeds them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _runtime as rt

Q = 8
EDIT_RATE = 0.1
BLOCK_CHARS = 2_000_000  # of the benchmark in one broadcast; an item may exceed it alone
PASS_CHARS = 32_000_000  # of the benchmark in one pass over the documents
PAIRS = 1 << 21  # of equal q-grams held at a time
_GAP = 0x110000  # between texts: no character
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD1B54A32D192ED03)
_CHUNK = 1 << 20


def folded(text: str) -> str:
    """Lower case that keeps every character's place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _wrapped(x: np.uint64) -> np.uint64:
    return np.uint64(int(x) * int(x) & 0xFFFFFFFFFFFFFFFF)


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of q codes, by doubling."""
    width, h, power = 1, c.astype(np.uint64) + np.uint64(1), _BASE
    out, done = None, 0
    while True:
        if q & width:
            if out is None:
                out, done = h, width
            else:
                n = len(h) - done
                out = out[:n] * power + h[done : done + n] if n > 0 else h[:0]
                done += width
        if width * 2 > q:
            break
        n = len(h) - width
        h = h[:n] * power + h[width:] if n > 0 else h[:0]
        power = _wrapped(power)
        width *= 2
    return out[: max(0, len(c) - q + 1)]


def budget(m: int, q: int, rate: float) -> int:
    """Edits allowed in a passage of m characters: the rate's, as far as one shared q-gram is certain."""
    return max(0, min(int(rate * m), (m - q) // q))


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """(edits, text start) of item's best occurrence with diagonals low <= d < high.

    Any start and end inside the band is free.  The start follows from the
    diagonal where a best path begins.
    """
    width = high - low
    padded = np.full(len(item) + width, _GAP, np.uint32)
    a, b = max(0, low), min(len(text), low + len(padded))
    if b > a:
        padded[a - low : b - low] = text[a:b]
    step = np.arange(width)
    # Starts before the text are not free: they skip no characters that exist.
    cost = np.zeros(width, np.int64)
    big = 1 << 20
    origin = step + low
    for i, c in enumerate(item.tolist()):
        kept = cost + (padded[i : i + width] != c)
        dropped = np.append(cost[1:] + 1, big)
        take = dropped < kept
        best = np.where(take, dropped, kept)
        start = np.where(take, np.append(origin[1:], 0), origin)
        run = np.minimum.accumulate((best - step) * width + step)
        source = run % width
        cost = best[source] + step - source
        origin = start[source]
    at = int(cost.argmin())
    return int(cost[at]), max(0, int(origin[at]))


class _Tally:
    """Sums of counts by number, in memory that follows the different numbers."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if not len(keys):
            return
        k, n = self._sums(keys, counts)
        if len(self.keys):
            k, n = self._sums(np.concatenate([self.keys, k]), np.concatenate([self.counts, n]))
        self.keys, self.counts = k, n

    @staticmethod
    def _sums(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        low = int(keys.min())
        if int(keys.max()) - low <= 4 * len(keys):  # close together: no sort
            n = np.bincount(keys - low, counts)
            k = np.flatnonzero(n)
            return k + low, n[k].astype(np.int64)
        k, back = np.unique(keys, return_inverse=True)
        return k, np.bincount(back, counts, len(k)).astype(np.int64)


def _slices(counts: np.ndarray) -> list[tuple[int, int]]:
    """Ranges whose counts add up to at most PAIRS, or of one entry."""
    ends, out, a = np.cumsum(counts), [], 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(ends, (int(ends[a - 1]) if a else 0) + PAIRS, side="right")))
        out.append((a, b))
        a = b
    return out


def _expanded(firsts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, owner) of all entries firsts[i], firsts[i] + 1, ..., counts[i] of them."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner] + firsts[owner], owner


def _among(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in sorted_keys, whether it is there) of keys."""
    k = np.searchsorted(sorted_keys, keys)
    k[k == len(sorted_keys)] = 0
    return k, sorted_keys[k] == keys


@dataclass
class Found:
    item_id: int
    edits: int
    start: int


class Index:
    """The q-grams of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = EDIT_RATE):
        self.q = q
        kept = [(i, folded(t)) for i, t in items if t is not None and len(t) >= q]
        self.short = [(i, folded(t)) for i, t in items if t is not None and len(t) < q and t.strip()]
        self.ids = [i for i, _ in kept]
        self.texts = [t for _, t in kept]
        self.codes = [codes(t) for t in self.texts]
        sizes = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.array([budget(int(m), q, rate) for m in sizes], np.int64)
        self.needed = sizes - q + 1 - self.edits * q
        self.size = sizes
        grams = [gram_hashes(c, q) for c in self.codes]
        h = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.item = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])[order] if grams else np.zeros(0, np.int32)
        self.pos = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams])[order] if grams else np.zeros(0, np.int32)
        # Entries are sorted by q-gram, item and place; a run is one item's share of one q-gram.
        h = h[order]
        new_hash = np.ones(len(h), bool)
        new_hash[1:] = h[1:] != h[:-1]
        new_run = new_hash.copy()
        new_run[1:] |= self.item[1:] != self.item[:-1]
        self.hash, self.run = h[new_hash], np.flatnonzero(new_run)
        self.run_item, self.run_size = self.item[self.run], np.diff(np.append(self.run, len(h)))
        self.first = np.append(np.flatnonzero(new_hash[self.run]), len(self.run))
        self.shift = np.uint64(64 - max(10, min(24, int(len(h) * 8).bit_length())))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[(self.hash * _SPREAD) >> self.shift] = True

    def find(self, texts: list[str]) -> list[list[Found]]:
        out: list[list[Found]] = [[] for _ in texts]
        for t, found in zip(texts, out, strict=True) if self.short else ():
            low = folded(t)
            found += [Found(i, 0, start) for i, x in self.short if (start := low.find(x)) >= 0]
            found.sort(key=lambda f: f.item_id)
        if not self.ids:
            return out
        group, size = [], 0
        for i, t in enumerate(texts):
            if len(t) >= self.q:
                if size and size + len(t) > _CHUNK:
                    self._find(group, texts, out)
                    group, size = [], 0
                group.append(i)
                size += len(t)
        if group:
            self._find(group, texts, out)
        return out

    def _find(self, group: list[int], texts: list[str], out: list[list[Found]]) -> None:
        low = [folded(texts[i]) for i in group]
        own = [codes(t) for t in low]
        gap = np.array([_GAP], np.uint32)
        whole = np.concatenate([x for c in own for x in (c, gap)])
        begins = np.concatenate([[0], np.cumsum([len(c) + 1 for c in own])])
        h = gram_hashes(whole, self.q)
        at = np.flatnonzero(self.seen[(h * _SPREAD) >> self.shift])
        if not len(at):
            return
        where = np.searchsorted(self.hash, h[at])
        where[where == len(self.hash)] = 0
        same = self.hash[where] == h[at]
        at, where = at[same], where[same]
        doc = np.searchsorted(begins, at, side="right") - 1
        at = at - begins[doc]
        items = len(self.ids)

        def shares(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(document and item as one number, run, place in the text) of shared q-grams."""
            run, owner = _expanded(self.first[where[a:b]], counts[a:b])
            return doc[a:b][owner] * items + self.run_item[run], run, at[a:b][owner]

        # A pair with too few shared q-grams in all has too few in every band.
        counts = self.first[where + 1] - self.first[where]
        total, slices = _Tally(), _slices(counts)
        held = shares(*slices[0]) if len(slices) == 1 else None
        for x in slices:
            pair, run, _ = held or shares(*x)
            total.add(pair, self.run_size[run])
        enough = total.keys[total.counts >= self.needed[total.keys % items]]
        best: dict[tuple[int, int], Found] = {}
        if int(total.counts.sum()) > PAIRS:  # before many pairs are made, settle what occurs as it is
            for d, i in zip((enough // items).tolist(), (enough % items).tolist(), strict=True):
                if (start := low[d].find(self.texts[i])) >= 0:
                    best[d, i] = Found(self.ids[i], 0, start)
            enough = enough[[(p // items, p % items) not in best for p in enough.tolist()]]
        if len(enough):
            self._align(enough, slices, held or shares, own, low, best)
        for (d, _), f in best.items():
            out[group[d]].append(f)
        for i in group:
            out[i].sort(key=lambda f: f.item_id)

    def _align(self, enough: np.ndarray, slices: list[tuple[int, int]], shares, own: list[np.ndarray], low: list[str], best: dict[tuple[int, int], Found]) -> None:
        """Count the shared q-grams of these pairs by band and align where the bound is reached."""
        items, longest = len(self.ids), int(self.size.max())
        most = int((max(len(c) for c in own) + longest) // (self.edits.min() + 1)) + 3

        def banded(x: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Of a slice, a bounded number of equal q-grams at a time: both bands, and the place in the item."""
            pair, run, at = shares(*x) if callable(shares) else shares
            ok = _among(enough, pair)[1]
            pair, run, at = pair[ok], run[ok], at[ok]
            for a, b in _slices(self.run_size[run]):
                entry, owner = _expanded(self.run[run[a:b]], self.run_size[run[a:b]])
                pos, one = self.pos[entry].astype(np.int64), pair[a:b][owner]
                item = one % items
                band = one * most + (at[a:b][owner] - pos + self.size[item]) // (self.edits[item] + 1)  # not negative
                yield np.concatenate([band + 1, band]), np.concatenate([pos, pos])  # each band and the one before, numbered from 0

        in_band = _Tally()
        for x in slices:
            for band, _ in banded(x):
                in_band.add(band)
        keys = in_band.keys[in_band.counts >= self.needed[in_band.keys // most % items]]
        if not len(keys):
            return
        # Where the bound is reached, count each q-gram of the passage once.
        once = _Tally()
        for x in slices:
            for band, pos in banded(x):
                k, ok = _among(keys, band)
                once.add(k[ok] * longest + pos[ok])
        n = np.bincount(once.keys // longest, minlength=len(keys))
        ok = n >= self.needed[keys // most % items]
        keys, n = keys[ok], n[ok]
        # Fewer edits than this would have left more q-grams whole.
        fewest = -(-(self.size[keys // most % items] - self.q + 1 - n) // self.q)
        where: dict[tuple[int, int], int] = {}
        for d, i, j, least in zip((keys // most // items).tolist(), (keys // most % items).tolist(), (keys % most - 1).tolist(), fewest.tolist(), strict=True):
            had = best.get((d, i))
            # A band beyond the next one starts later, so it must have fewer edits.
            if had is not None and (had.edits == 0 or j >= where[d, i] + 2 and least >= had.edits):
                continue
            k = int(self.edits[i])
            start = low[d].find(self.texts[i])
            if start >= 0:
                edits = 0
            else:
                first = j * (k + 1) - int(self.size[i])
                edits, start = banded_distance(self.codes[i], own[d], first, first + 2 * (k + 1))
            if edits <= k and (had is None or (edits, start) < (had.edits, had.start)):
                best[d, i], where[d, i] = Found(self.ids[i], edits, start), j


_built: dict[str, Index] = {}
KEPT = 2  # indexes that a worker holds


def _index(key: str, items: list[tuple[int, str]], q: int, rate: float) -> Index:
    found = _built.pop(key, None)
    while len(_built) >= KEPT:
        del _built[next(iter(_built))]
    _built[key] = found or Index(items, q, rate)
    return _built[key]


def _blocks(benchmark: DataFrame, block_chars: int, unnamed: bool = False) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size; the driver holds one at a time.  unnamed: those without an id too, as -1."""
    block, size = [], 0
    own = F.col("item_id").cast("long")
    for r in benchmark.select((F.coalesce(own, F.lit(-1)) if unnamed else own).alias("i"), F.col("text").alias("t")).where("t is not null and i is not null").toLocalIterator():
        if block and size + len(r.t) > block_chars:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t)
    if block:
        yield block


def _passes(spark, blocks: Iterator[list[tuple[int, str]]], pass_chars: int) -> Iterator[list]:
    """Broadcast blocks, as many together as one pass over the documents takes."""
    held, size = [], 0
    for block in blocks:
        n = sum(len(t) for _, t in block)
        if held and size + n > pass_chars:
            yield held
            held, size = [], 0
        held.append((uuid.uuid4().hex, spark.sparkContext.broadcast(block)))
        size += n
    if held:
        yield held


FOUND = "doc_id long, item_id long, edits int, start long"


def find(
    docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS, pass_chars: int = PASS_CHARS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, edits, start) of every benchmark item in every document."""
    spark = docs.sparkSession
    rt.prepare(spark)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for blocks in _passes(spark, _blocks(benchmark, block_chars), pass_chars):
        one = chosen.mapInArrow(_finder(blocks, q, rate), FOUND)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], FOUND)


def _finder(blocks: list, q: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for key, block in blocks:
                index = _index(key, block.value, q, rate)
                for b in rt.small(iter([whole])):
                    found = index.find(rt.texts(b.column(1)))
                    rows = [(d, f.item_id, f.edits, f.start) for d, fs in zip(b.column(0).to_pylist(), found, strict=True) for f in fs]
                    if rows:
                        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "item_id", "edits", "start"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS, pass_chars: int = PASS_CHARS, text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item; columns as they are."""
    spark = docs.sparkSession
    rt.prepare(spark)
    at, before = docs.columns.index(text_col), None
    for n, blocks in enumerate(_passes(spark, _blocks(benchmark, block_chars, unnamed=True), pass_chars)):
        if n:  # one Python worker at a time: what the last pass kept is written
            docs = rt.materialize(docs, "clean")
            rt.drop(before)
            before = docs
        docs = docs.mapInArrow(_cleaner(blocks, at, q, rate), docs.schema)
    return docs


def _cleaner(blocks: list, at: int, q: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, block in blocks:
                index = _index(key, block.value, q, rate)
                keep = [not f for part in rt.small(iter([b])) for f in index.find(rt.texts(part.column(at)))]
                b = b.filter(pa.array(keep, pa.bool_()))
            yield b

    return run

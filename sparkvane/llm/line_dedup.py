"""Exact line dedup over a corpus, returning keep bitmaps instead of text.

Lines become 128-bit hashes of their keys.  The hashes are range-partitioned
and sorted by (hash, document, position); one pass over each sorted partition
keeps a key's lines in the first document and reports the others.  The range
includes the document, so a line that a third of all documents share spreads
over many partitions; only a partition's first key can continue an earlier
partition, and the first and last key of each partition settle that.

Defined results: null or empty text is one empty line; keys shorter than
``min_chars`` code points are never dropped; a key's repeats inside its first
document stay; a null doc_id sorts before all others; rows that repeat a
doc_id count as one document, and a bitmap holds for rows with the same text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from . import _runtime as rt

MIN_CHARS = 10
#: What is stripped from both ends of a line for its key: [\x20\x09-\x0D].
STRIPPED = " \t\n\x0b\f\r"
_NULL_ID = np.iinfo(np.int64).min


_HASHES = "h1 long, h2 long, doc long, version long, n_lines int, pos int"


def line_keys(text: str, min_chars: int = MIN_CHARS) -> tuple[list[int], list[bytes], int]:
    """(positions, keys, number of lines): the lines whose keys are long enough."""
    at, keys, lines = [], [], text.split("\n")
    for pos, line in enumerate(lines):
        key = line.strip(STRIPPED)
        if len(key) >= min_chars:
            at.append(pos)
            keys.append(key.encode("utf-8", "surrogatepass").lower())  # of bytes: A-Z alone
    return at, keys, len(lines)


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row (h1, h2, doc, version, n_lines, pos) for each line with a long enough key."""
    rt.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rt.small(batches):
            found = [line_keys(t, min_chars) for t in rt.texts(b.column(2))]
            digests = np.frombuffer(b"".join(xxh3_128_digest(k) for _, keys, _ in found for k in keys), "<i8").reshape(-1, 2)
            own = pa.array(np.repeat(np.arange(b.num_rows), [len(at) for at, _, _ in found]))
            n = pa.array([n for _, _, n in found], pa.int32())
            pos = pa.array([p for at, _, _ in found for p in at], pa.int32())
            cols = [pa.array(digests[:, 0]), pa.array(digests[:, 1]), b.column(0).take(own), b.column(1).take(own), n.take(own), pos]
            yield pa.RecordBatch.from_arrays(cols, [x.strip().split(" ")[0] for x in _HASHES.split(",")])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("version"), text.alias("text")).mapInArrow(run, _HASHES)


_MARKS = "kind int, part int, h1 long, h2 long, doc long, version long, n_lines int, pos int"
_DROP, _OPEN, _FIRST, _LAST = 0, 1, 2, 3


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dropped lines of one sorted partition; the kept lines of its first key as
    open ones, and its first and last key."""
    part = TaskContext.get().partitionId()
    key: tuple[int, int] | None = None  # of the row before
    opening: tuple[int, int] | None = None  # the partition's first key
    owner = 0  # the first document that has it

    def rows(kind: np.ndarray, b: list[np.ndarray], null_doc: np.ndarray) -> pa.RecordBatch:
        cols = [pa.array(kind.astype(np.int32)), pa.array(np.full(len(kind), part, np.int32))]
        cols += [pa.array(b[0]), pa.array(b[1]), pa.array(b[2], mask=null_doc), pa.array(b[3]), pa.array(b[4]), pa.array(b[5])]
        return pa.RecordBatch.from_arrays(cols, [x.strip().split(" ")[0] for x in _MARKS.split(",")])

    for batch in batches:
        if not batch.num_rows:
            continue
        b = [c.fill_null(_NULL_ID).to_numpy() if i == 2 else c.to_numpy() for i, c in enumerate(batch.columns)]
        h1, h2, doc = b[:3]
        new = np.empty(len(h1), bool)
        new[0] = key != (int(h1[0]), int(h2[0]))
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        run = np.cumsum(new)  # 0: goes on from the batch before
        owners = np.concatenate([[owner], doc[new]])
        kind = np.full(len(h1), -1)
        kind[doc != owners[run]] = _DROP
        if opening is None:
            opening = (int(h1[0]), int(h2[0]))
            yield rows(np.array([_FIRST]), [x[:1] for x in b], np.array([False]))
        if opening == (int(h1[0]), int(h2[0])):
            kind[(kind < 0) & (h1 == opening[0]) & (h2 == opening[1])] = _OPEN
        out = kind >= 0
        if out.any():
            yield rows(kind[out], [x[out] for x in b], doc[out] == _NULL_ID)
        key, owner, last = (int(h1[-1]), int(h2[-1])), int(owners[-1]), [x[-1:].copy() for x in b]
    if key is not None:
        yield rows(np.array([_LAST]), last, np.array([False]))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, version, n_lines, pos) of every line that goes."""
    spark = docs.sparkSession
    rt.prepare(spark)
    order = ["h1", "h2", "doc"]
    # Written first: the ranges are then sampled from the hashes, not from a second pass over the texts.
    hashes = rt.materialize(line_hashes(docs, id_col, text_col, min_chars), "line-hashes")
    placed = hashes.repartitionByRange(rt.partitions(spark), *order).sortWithinPartitions(*order, "version", "pos")
    marks = rt.materialize(placed.mapInArrow(_first_occurrences, _MARKS), "lines")
    rt.drop(hashes)
    # Two rows for each partition, however large the corpus.
    edges = marks.where(F.col("kind").isin(_FIRST, _LAST)).select("part", "kind", "h1", "h2").orderBy("part", "kind").collect()
    going_on, before = [], None
    for r in edges:
        if r.kind == _FIRST and before == (r.h1, r.h2):
            going_on.append(r.part)
        if r.kind == _LAST:
            before = (r.h1, r.h2)
    gone = (F.col("kind") == _DROP) | ((F.col("kind") == _OPEN) & F.col("part").isin(going_on))
    return marks.where(gone).select("doc", "version", "n_lines", "pos")


def pack(n_lines: int, dropped: np.ndarray) -> bytes:
    keep = np.ones(n_lines, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines, bitorder="little").astype(bool)


BITMAPS = "doc_id long, version long, n_lines int, n_dropped int, keep binary"


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One compressed bitmap for each document that loses a line; the others keep
    all of theirs.  ``version`` is the xxhash64 of the text that the bits belong to."""
    gone = dropped_lines(docs, id_col, text_col, min_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rt.small(batches):
            sizes = b.column(2).to_pylist()
            at = [np.unique(x) for x in b.column(3).to_pylist()]
            cols = [b.column(0), b.column(1), b.column(2), pa.array([len(x) for x in at], pa.int32()), pa.array([pack(n, x) for n, x in zip(sizes, at, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "version", "n_lines", "n_dropped", "keep"])

    # A group is one document's lines: as large as its text, no larger, however often the row is repeated.
    per_doc = gone.groupBy("doc", "version", "n_lines").agg(F.collect_set("pos").alias("at"))
    return per_doc.select("doc", "version", "n_lines", "at").mapInArrow(run, BITMAPS)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """docs with the kept text; with counts, n_lines (before) and n_dropped after its columns.

    Every row of docs stays; a null text becomes the empty text.  Columns of
    docs that are named like the counts give way to them.
    """
    rt.prepare(docs.sparkSession)
    added = ["n_lines", "n_dropped"] if counts else []
    own = [c for c in docs.columns if c.lower() not in added]
    version, bits, other, doc = rt.unused(docs, "line_version", "line_keep", "line_other", "line_doc")
    left = docs.select(*[F.col(f"`{c}`") for c in own], F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(version))
    right = bitmaps.select(F.col("doc_id").alias(doc), F.col("version").alias(other), F.col("keep").alias(bits)).hint("shuffle_hash")
    both = left.join(right, left[id_col].cast("long").eqNullSafe(right[doc]) & (left[version] == right[other]), "left").select(*[F.col(f"`{c}`") for c in own], bits)
    at = own.index(text_col)
    schema = docs.select(*[F.col(f"`{c}`") for c in own], *[F.lit(0).cast("long").alias(c) for c in added]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rt.small(batches):
            kept, sizes, gone = [], [], []
            for text, keep in zip(rt.texts(b.column(at)), b.column(len(own)).to_pylist(), strict=True):
                n = text.count("\n") + 1
                if keep is None:
                    kept.append(text)
                    gone.append(0)
                else:
                    mask = unpack(keep, n)
                    kept.append("\n".join(x for x, k in zip(text.split("\n"), mask.tolist(), strict=True) if k))
                    gone.append(n - int(mask.sum()))
                sizes.append(n)
            cols = [pa.array(kept, pa.string()) if i == at else c for i, c in enumerate(b.columns[: len(own)])]
            cols += [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())] if counts else []
            yield pa.RecordBatch.from_arrays(cols, [*own, *added])

    return both.mapInArrow(run, schema)

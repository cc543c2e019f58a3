"""Token ids in ORC files.

Documents are range-partitioned and sorted by id, encoded, and written one
file for each partition: doc_id, the tokens before it in its file, its count
and its ids.  Ids are integer columns, so ORC's run-length encoding packs
them; row indexes and Bloom filters on doc_id let readers skip stripes, and
stripes are read in parallel.  A document's global start is its file's base
(a prefix sum over per-file totals) plus its offset.

The ranges are quantiles of doc_id alone, a pass over one column.  An id that
fills several ranges (null, say) is dealt over them by its texts' hashes.

Defined results: null is the empty text, whose only id is the end id; rows
with equal doc_id are ordered by a hash of their text, then text; a null
doc_id comes first, as if it were the least integer.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _runtime as rt

END_ID = 2
STRIPE_BYTES = 16 << 20
INDEX_STRIDE = 1000  # rows between two entries of a row index
MAX_PARTS = 1_000_000  # remembered pre-tokens; forgotten all at once when there are more
FILE = "doc_id long, offset long, n_tokens int, ids array<int>"
#: Texts of these characters alone are composed already, and lower case is one character each.
_PLAIN = re.compile("[\\t\\n\\r -~¡-ÿ]*")
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
#: Fixed value: the pre-tokenizer's own pattern, over lower-cased plain texts.
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
_END_MARK = "</w>"


class PartEncoder:
    """A tokenizers file that lower-cases, drops white space and marks word ends.

    No merge crosses a pre-token, so a text's ids are its pre-tokens' ids, and
    the library encodes each distinct pre-token once.  Texts outside Latin-1,
    or with an added token in them, go through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        vocabulary = self.lib.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith(_END_MARK)
        self.parts: dict[str, bytes] = {}
        for probe in ("Ab, c.d  e'll\n(F)éÉ x1", "don't STOP. ''s 12½\tok", " "):
            if b"".join(self.encode([probe])) != self._whole(probe):
                raise ValueError("the tokenizer splits texts otherwise")

    def _whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.int32).tobytes()

    def _learn(self, new: set[str]) -> None:
        """Encode all new pre-tokens in one call; each one's last token marks its end."""
        names = list(new)
        ids = np.array(self.lib.encode_batch_fast([" ".join(names)], add_special_tokens=False)[0].ids, np.int32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(names):
            raw, ends = ids.tobytes(), (cuts * 4).tolist()
            self.parts.update(zip(names, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=False))
        else:
            self.parts.update((n, self._whole(n)) for n in names)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as native 32-bit integers."""
        if len(self.parts) > MAX_PARTS:
            self.parts.clear()
        known, out, later, new = self.parts.get, [], [], set()
        for t in texts:
            if not _PLAIN.fullmatch(t) or any(a in t for a in self.added):
                out.append(self._whole(t))
                continue
            parts = _PARTS.findall(t.lower())
            ids = list(map(known, parts))
            if None in ids:
                gaps = [k for k, x in enumerate(ids) if x is None]
                new.update(map(parts.__getitem__, gaps))
                later.append((len(out), parts, ids, gaps))
                out.append(b"")
            else:
                out.append(b"".join(ids))
        if new:
            self._learn(new)
            for i, parts, ids, gaps in later:
                for k in gaps:
                    ids[k] = known(parts[k])
                out[i] = b"".join(ids)
        return out


_loaded: dict[str, PartEncoder] = {}


def load(path: str) -> PartEncoder:
    """The encoder of one file, once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = PartEncoder(path)
    return _loaded[path]


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Token counts of texts, by the remembering encoder."""

    def count(texts: list[str]) -> list[int]:
        return [len(x) // 4 for x in load(path).encode(texts)]

    return count


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode docs and write them below path, in ascending doc_id order."""
    spark = docs.sparkSession
    rt.prepare(spark)
    end = np.array([end_id], np.int32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at = load(tokenizer), 0
        for b in rt.small(batches):
            packed = [x + end for x in encoder.encode(rt.texts(b.column(1)))]
            sizes = np.array([len(x) // 4 for x in packed], np.int64)
            ends = np.cumsum(sizes)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            cols = [b.column(0), pa.array(at + ends - sizes), pa.array(sizes.astype(np.int32)), ids]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "offset", "n_tokens", "ids"])
            at += int(sizes.sum())

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = rt.partitions(spark)
    spread = F.pmod(F.xxhash64("text"), F.lit(_SPREAD)).cast("int")
    placed = chosen.select("*", spread.alias("spread"), _place(_bounds(chosen, n), F.col("doc_id"), spread).alias("part"))
    placed = placed.repartitionById(n, "part").sortWithinPartitions("doc_id", "spread", "text").select("doc_id", "text")
    options = {"orc.compress": "ZSTD", "orc.stripe.size": STRIPE_BYTES, "orc.rows.between.memory.checks": 512, "orc.row.index.stride": INDEX_STRIDE}
    options |= {"orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    placed.mapInArrow(run, FILE).write.options(maxRecordsPerFile=0, **options).orc(path)


_LEAST = -(1 << 63)
_SPREAD = 1 << 20


def _bounds(docs: DataFrame, parts: int) -> list[int]:
    """Quantiles of doc_id that cut it into so many ranges; only that column is read."""
    if parts < 2:
        return []
    shares = [k / parts for k in range(1, parts)]
    key = F.coalesce("doc_id", F.lit(_LEAST))
    return docs.select(F.percentile_approx(key, F.lit(shares), F.lit(max(10_000, 10 * parts)))).first()[0] or []


def _place(bounds: list[int], key: Column, spread: Column) -> Column:
    """The range of a doc_id; ranges that it fills whole share its rows in the order of spread.

    Bounds are looked up in two steps, so a row meets about twice the root of their number.
    """
    if not bounds:
        return F.lit(0)
    own, step = F.coalesce(key, F.lit(_LEAST)), math.isqrt(len(bounds)) + 1
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]

    def below(reaches) -> Column:
        """How many bounds the comparison holds for; it holds for a first part of them."""
        at = F.size(F.filter(F.lit([r[-1] for r in rows]), lambda b: reaches(b)))
        row = F.get(F.array(*[F.lit(r) for r in rows]), at)
        return at * step + F.coalesce(F.size(F.filter(row, lambda b: reaches(b))), F.lit(0))

    low, high = below(lambda b: b < own), below(lambda b: b <= own)
    return F.least(low + F.floor(spread * (high - low + 1) / _SPREAD), F.lit(len(bounds))).cast("int")


def part_number(name: Column) -> Column:
    """The number of the task that wrote a file; names alone sort wrongly beyond 100,000 files."""
    return F.regexp_extract(name, r"part-(\d+)", 1).cast("long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the ids of all documents before each one."""
    rt.prepare(spark)
    rows = spark.read.schema(FILE).orc(path).withColumn("part", part_number(F.col("_metadata.file_name")))
    # One row for each file, in the order of the ranges.
    totals = rows.groupBy("part").agg(F.max(F.col("offset") + F.col("n_tokens")).alias("total")).orderBy("part").collect()
    bases, at = [], 0
    for r in totals:
        bases.append((r.part, at))
        at += r.total
    base = spark.createDataFrame(bases, "part long, base long")
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), F.col("n_tokens").cast("long"), "ids")


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows as read() gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rt.small(batches):
            lists = b.column(3)
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[s:e].astype("<u4").tobytes()) for s, e in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

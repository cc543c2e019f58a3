"""The corpus: an immutable snapshot of quantized unit vectors, as a DataFrame."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import scaled
from ..limits import LOAD_CHUNK_BYTES, MAX_ELEMENTS, MAX_ROWS, TILE_ROWS, InvalidInput, check_dimensions, check_rows, padded
from ..sources import ingest
from ..sources.storage import Manifest, Store, upsert


@dataclass(frozen=True)
class BuildMemory:
    resident_bytes: int
    peak_bytes: int


@dataclass(frozen=True)
class CorpusMemory:
    """Logical bytes; frames have neither padding nor slack."""

    vectors: int
    norms: int
    dimension_padding: int = 0
    vector_slack: int = 0
    norm_slack: int = 0

    @property
    def total(self) -> int:
        return self.vectors + self.norms + self.dimension_padding + self.vector_slack + self.norm_slack


class Corpus:
    """``df`` has (id LONG, hv ARRAY<FLOAT>, inv_norm FLOAT), ids 0..len-1.

    Mutations return new snapshots and leave this one as it is.  A snapshot
    that belongs to a store writes its children there, as the store's newest
    version; if another writer has done so first, they raise Conflict.  Encoding
    is lazy: a snapshot that is neither saved nor persisted encodes its rows in
    every search.
    """

    def __init__(self, df: DataFrame, dimensions: int, count: int, store: Store | None = None, manifest: Manifest | None = None, head: bool = True):
        self.df, self.dimensions, self.count, self.store, self.manifest = df, check_dimensions(dimensions), check_rows(count), store, manifest
        self._head = head

    # Building

    @classmethod
    def build(cls, rows: DataFrame, dimensions: int, count: int | None = None, id_col: str | None = "id", vector_col: str = "v") -> Corpus:
        """From float rows: validated, normalized, rounded to binary16.

        With id_col the ids must be dense; with None they are the rows' order.
        A declared count must be right.  Rows are checked where they are encoded.
        """
        return cls._built(rows, dimensions, count, id_col, vector_col, ingest.encode)

    @classmethod
    def build_half(cls, rows: DataFrame, dimensions: int, count: int | None = None, id_col: str | None = "id", vector_col: str = "v") -> Corpus:
        """From binary16 rows (bytes or exact floats), whose components stay unchanged."""
        return cls._built(rows, dimensions, count, id_col, vector_col, ingest.encode_half)

    @classmethod
    def _built(cls, rows, dimensions, count, id_col, vector_col, encoder) -> Corpus:
        check_dimensions(dimensions)
        if id_col is None:
            rows, n = ingest.with_ids(rows.select(F.col(vector_col).alias("v")))
        else:
            rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
            n = ingest.check_ids(rows)
        if count is not None and n != count:
            raise InvalidInput(f"{n} rows, not the declared {count}")
        return cls(encoder(rows, dimensions), dimensions, n)

    @classmethod
    def adopt(cls, spark: SparkSession, shards: list[DataFrame], dimensions: int) -> Corpus:
        """From padded matrices (pos, v), in list order; padding must be zero."""
        df, n = ingest.adopt(shards, dimensions, spark)
        return cls(df, dimensions, n)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: str | None = None) -> Corpus:
        """A saved version, the newest by default; its shape is checked, its payload trusted."""
        store = Store(spark, path)
        m = store.manifest(version)
        store.page_rows = m.page_rows
        store.check(m)
        return cls._at(store, m)

    @classmethod
    def _at(cls, store: Store, m: Manifest, head: bool = True) -> Corpus:
        return cls(store.read(m), m.dimensions, m.count, store, m, head)

    def fork(self) -> Corpus:
        """This snapshot as the root of a branch: its children never become the store's newest version."""
        return Corpus(self.df, self.dimensions, self.count, self.store, self.manifest, False)

    def save(self, path: str, page_rows: int | None = None) -> Corpus:
        """Write a version to a store and return it as a snapshot of that store."""
        store = Store(self.spark, path, **({"page_rows": page_rows} if page_rows else {}))
        return self._at(store, store.save(self.df, self.dimensions, self.count))

    # Shape

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def __len__(self) -> int:
        return self.count

    @property
    def is_empty(self) -> bool:
        return not self.count

    @property
    def padded_dimensions(self) -> int:
        return padded(self.dimensions)

    @property
    def capacity_range(self) -> range:
        return range(self.count)

    @property
    def version(self) -> str | None:
        return self.manifest.version if self.manifest else None

    @property
    def shard_count(self) -> int:
        """Files of a stored corpus, else partitions that have rows; never part of a result."""
        return len(self.df.inputFiles()) if self.manifest else self.df.select(F.spark_partition_id()).distinct().count()

    def shards(self) -> DataFrame:
        """The rows, for scorers of one's own."""
        return self.df

    def memory_usage(self) -> CorpusMemory:
        return CorpusMemory(self.count * self.dimensions * 2, self.count * 4)

    @staticmethod
    def build_memory(dimensions: int, count: int) -> BuildMemory:
        """What a padded, tiled resident copy of this shape takes, and with loader staging."""
        check_dimensions(dimensions)
        check_rows(count)
        if not count:
            return BuildMemory(0, 0)
        row_bytes = padded(dimensions) * 2 + 4
        shard = max(TILE_ROWS, MAX_ELEMENTS // padded(dimensions) // TILE_ROWS * TILE_ROWS)
        whole, rest = divmod(count, shard)
        capacity = whole * shard + -(-rest // TILE_ROWS) * TILE_ROWS
        staged = min(count, max(1, LOAD_CHUNK_BYTES // (padded(dimensions) * 2)))
        return BuildMemory(capacity * row_bytes, (capacity + 2 * staged) * row_bytes)

    def persist(self) -> Corpus:
        self.df = self.df.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> Corpus:
        self.df.unpersist()
        return self

    def searcher(self, **config):
        from .search import Searcher

        return Searcher(self, **config)

    # Gathering

    def gather(self, ids: Iterable[int] | DataFrame) -> DataFrame:
        """(pos, id, v): rows as unit vectors, in the order asked for, repeats kept.

        A frame has (pos, id).  An id out of range raises before any row is read.
        """
        if isinstance(ids, DataFrame):
            r = ids.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.count("id").alias("known")).first()
            n, low, high = r.n, r.low, r.high
            if r.known != n:
                raise InvalidInput("a gathered ID is null")
            asked = ids.select("pos", "id")
        else:
            ids = [int(i) for i in ids]
            n, low, high = len(ids), min(ids, default=None), max(ids, default=None)
            asked = self.spark.createDataFrame(list(enumerate(ids)), "pos long, id long")
        if n and not (low >= 0 and high < self.count):
            raise InvalidInput("a gathered ID is outside the corpus")
        if n > MAX_ROWS or n * self.dimensions > MAX_ELEMENTS:
            raise InvalidInput("a gather is too large")
        # The range prunes row groups of a stored corpus by their statistics on id.
        rows = self.df.where(F.col("id").between(low, high)) if n else self.df.limit(0)
        return asked.join(rows, "id").select("pos", "id", scaled(F.col("hv"), F.col("inv_norm")).alias("v"))

    # Mutation

    def append(self, rows: DataFrame, half: bool = False, id_col: str | None = None, vector_col: str = "v", batch: tuple[str, int] | None = None) -> Corpus:
        """A snapshot with rows after these; no rows, no change.

        Rows are numbered in their order, or by an id_col that is dense from 0.
        In a store, batch is a stream's name and the number of the micro-batch that
        the rows are; one that is in the snapshot already changes nothing.
        """
        if batch and self.store and self.manifest.streams.get(batch[0], -1) >= batch[1]:
            return self
        if id_col is None:
            placed, n = ingest.with_ids(rows.select(F.col(vector_col).alias("v")), self.count)
        else:
            placed = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
            n = ingest.check_ids(placed)
            placed = placed.withColumn("id", F.col("id") + self.count)
        if not n:
            return self
        check_rows(self.count + n)
        new = (ingest.encode_half if half else ingest.encode)(placed, self.dimensions)
        if self.store:
            return self._at(self.store, self.store.append(self.manifest, new, n, self._head, batch), self._head)
        self._evaluate(new)
        return Corpus(self.df.unionByName(new), self.dimensions, self.count + n)

    def update(self, rows: DataFrame, half: bool = False, id_col: str = "id", vector_col: str = "v") -> Corpus:
        """A snapshot with the rows of these ids replaced; ids are distinct and in range."""
        placed = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
        r = placed.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("kinds"), F.min("id").alias("low"), F.max("id").alias("high")).first()
        if not r.n:
            return self
        if r.kinds != r.n:
            raise InvalidInput("updated IDs must be distinct")
        if not (r.low >= 0 and r.high < self.count):
            raise InvalidInput("an updated ID is outside the corpus")
        if r.n > MAX_ELEMENTS // self.padded_dimensions:
            raise InvalidInput("an update is too large")
        new = (ingest.encode_half if half else ingest.encode)(placed, self.dimensions)
        if self.store:  # writing evaluates the rows
            return self._at(self.store, self.store.update(self.manifest, new, self._head), self._head)
        self._evaluate(new)
        return Corpus(upsert(self.df, new), self.dimensions, self.count)

    @staticmethod
    def _evaluate(rows: DataFrame) -> None:
        """Reject invalid rows now, before a snapshot that holds them exists."""
        rows.agg(F.sum("inv_norm"), F.max(F.size("hv"))).collect()

    def compact(self) -> Corpus:
        """The same rows, bit for bit, in as few parts as they need."""
        if self.store:
            return self._at(self.store, self.store.compact(self.manifest, self._head), self._head)
        files = max(1, -(-self.count * self.dimensions * 4 // (128 << 20)))
        return Corpus(self.df.repartitionByRange(files, "id").sortWithinPartitions("id"), self.dimensions, self.count)

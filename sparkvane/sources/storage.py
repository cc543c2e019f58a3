"""Versioned corpora in Parquet.

A store is a folder of immutable parts and one JSON manifest for each version.
A version lists its parts and, for each, the pages that later updates replaced.
Appends add a part; updates add a part with the touched pages rewritten; a
version's manifest is written last, under a fresh name, so readers of other
versions never notice.

The newest version is named by numbered head files, each created once and never
replaced; the highest that is whole counts.  A version becomes the next head
only if its parent is the head: of two writers from one parent the later gets
``Conflict`` and has changed nothing.  Children of a fork are published without
becoming the head.  Files are reached through Hadoop's file systems, as Spark
reaches them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..limits import PAGE_ROWS, Conflict, InvalidInput, check_dimensions, check_rows
from .ingest import CORPUS

FORMAT = 1
MAX_RANGES = 128  # ID ranges spelled out in a filter; more pages are joined
HEADS_KEPT = 8


@dataclass
class Part:
    path: str
    first_page: int
    last_page: int
    replaced: list[int] = field(default_factory=list)


@dataclass
class Manifest:
    dimensions: int
    count: int
    version: str
    parent: str | None
    page_rows: int
    parts: list[Part]
    format: int = FORMAT
    #: Of each stream that was appended, its last micro-batch.
    streams: dict[str, int] = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a new file beside its place and rename it, so that readers see all or nothing."""
    final, fs = _fs(spark, path)
    temporary, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    _write(fs, temporary, text)
    if fs.exists(final) or not fs.rename(temporary, final):
        fs.delete(temporary, False)
        raise OSError(f"cannot publish {path}")


def _write(fs, path, text: str) -> None:
    out = fs.create(path, False)
    out.write(bytearray(text.encode()))
    out.hsync()
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """The whole of a small file, through a file system that Spark knows."""
    p, fs = _fs(spark, path)
    source = fs.open(p)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def size_of(spark: SparkSession, path: str) -> int:
    p, fs = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength())


class Store:
    """Reads and publishes versions below one folder."""

    def __init__(self, spark: SparkSession, path: str, page_rows: int = PAGE_ROWS):
        self.spark, self.path, self.page_rows = spark, path.rstrip("/"), page_rows

    def _manifest_path(self, version: str) -> str:
        return f"{self.path}/versions/{version}.json"

    def head(self) -> tuple[int, str | None]:
        """The number and the version of the newest head; (0, None) of an empty store."""
        folder, fs = _fs(self.spark, f"{self.path}/heads")
        if not fs.exists(folder):
            return 0, None
        numbers = sorted((int(n) for x in fs.listStatus(folder) if (n := x.getPath().getName()).isdigit()), reverse=True)
        for n in numbers:
            if version := read_text(self.spark, f"{self.path}/heads/{n:020d}").strip():  # else its writer has not finished
                return numbers[0], version
        return max(numbers, default=0), None

    def manifest(self, version: str | None = None) -> Manifest:
        """One version's manifest, by default the head's; raises InvalidInput if it is no valid one."""
        try:
            name = version or self.head()[1]
            raw = json.loads(read_text(self.spark, self._manifest_path(name)))
            m = Manifest(**{**raw, "parts": [Part(**p) for p in raw["parts"]]})
            if m.format != FORMAT or m.version != name or m.page_rows < 1 or m.count < 0 or not all(p.first_page <= p.last_page for p in m.parts):
                raise ValueError("fields")
            check_dimensions(m.dimensions)
            check_rows(m.count)
            return m
        except InvalidInput:
            raise
        except Exception as e:
            raise InvalidInput(f"{self.path} holds no valid corpus version: {e}") from e

    def check_head(self, parent: str | None) -> int:
        """The number of the next head, if parent is the newest one's version."""
        n, version = self.head()
        if version != parent:
            raise Conflict(f"the newest version of {self.path} is {version}, not {parent}")
        return n + 1

    def publish(self, m: Manifest, head: bool = True) -> Manifest:
        n = self.check_head(m.parent) if head else 0
        write_text(self.spark, self._manifest_path(m.version), json.dumps(asdict(m)))
        if head:
            path, fs = _fs(self.spark, f"{self.path}/heads/{n:020d}")
            try:
                _write(fs, path, m.version)
            except Py4JJavaError as e:
                fs.delete(_fs(self.spark, self._manifest_path(m.version))[0], False)
                raise Conflict(f"another writer has published version {n} of {self.path}") from e
            fs.delete(_fs(self.spark, f"{self.path}/heads/{n - HEADS_KEPT:020d}")[0], False)
        return m

    def write_part(self, rows: DataFrame, first: int, last: int) -> Part:
        """Rows with first <= id <= last, clustered by page; Parquet's own statistics on id prune reads."""
        pages = range(first // self.page_rows, last // self.page_rows + 1)
        path = f"parts/{uuid.uuid4().hex}"
        files = max(1, min(len(pages), self.spark.sparkContext.defaultParallelism * 4))
        placed = rows.select("id", "hv", "inv_norm").repartitionByRange(files, "id").sortWithinPartitions("id")
        placed.write.option("compression", "zstd").parquet(f"{self.path}/{path}")
        return Part(path, pages[0], pages[-1])

    def read(self, m: Manifest) -> DataFrame:
        rows = None
        for p in m.parts:
            one = self.spark.read.schema(CORPUS).parquet(f"{self.path}/{p.path}")
            if p.replaced:
                gone = set(p.replaced)
                one = in_pages(one, [n for n in range(p.first_page, p.last_page + 1) if n not in gone], m.page_rows)
            rows = one if rows is None else rows.unionByName(one)
        return rows if rows is not None else self.spark.createDataFrame([], CORPUS)

    def check(self, m: Manifest) -> None:
        """Trust the payload, not its extent: the rows must be as many as the manifest says."""
        r = self.read(m).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("high")).first()
        if r.n != m.count or r.n and r.high != r.n - 1:
            raise InvalidInput(f"{self.path} holds {r.n} rows, its manifest says {m.count}")

    def save(self, rows: DataFrame, dimensions: int, count: int, parent: Manifest | None = None, head: bool = True) -> Manifest:
        """A version of its own, or a child of parent; either needs the head to be its parent."""
        before = parent.version if parent else self.head()[1]
        parts = [self.write_part(rows, 0, count - 1)] if count else []
        return self.publish(Manifest(dimensions, count, uuid.uuid4().hex, before, self.page_rows, parts, streams=dict(parent.streams) if parent else {}), head)

    def append(self, m: Manifest, rows: DataFrame, added: int, head: bool = True, batch: tuple[str, int] | None = None) -> Manifest:
        """A child of m with rows, whose ids go on from m's; batch names the micro-batch that they are."""
        if not added:
            return m
        if head:
            self.check_head(m.version)
        part = self.write_part(rows, m.count, m.count + added - 1)
        streams = {**m.streams, **({batch[0]: batch[1]} if batch else {})}
        return self.publish(Manifest(m.dimensions, m.count + added, uuid.uuid4().hex, m.version, m.page_rows, [*_copies(m), part], streams=streams), head)

    def update(self, m: Manifest, rows: DataFrame, head: bool = True) -> Manifest:
        """A child of m with the pages of rows' ids rewritten; all other pages are shared."""
        page = F.floor(F.col("id") / m.page_rows)
        touched = sorted(r.p for r in rows.select(page.alias("p")).distinct().collect())  # at most MAX_ROWS / page_rows
        if not touched:
            return m
        if head:
            self.check_head(m.version)
        old = in_pages(self.read(m), touched, m.page_rows)
        part = self.write_part(upsert(old, rows), touched[0] * m.page_rows, touched[-1] * m.page_rows)
        parts = [Part(p.path, p.first_page, p.last_page, sorted({*p.replaced, *(t for t in touched if p.first_page <= t <= p.last_page)})) for p in m.parts]
        parts = [p for p in parts if len(p.replaced) < p.last_page - p.first_page + 1]
        return self.publish(Manifest(m.dimensions, m.count, uuid.uuid4().hex, m.version, m.page_rows, [*parts, part], streams=dict(m.streams)), head)

    def compact(self, m: Manifest, head: bool = True) -> Manifest:
        """The same rows in one part."""
        return self.save(self.read(m), m.dimensions, m.count, m, head)


def in_pages(rows: DataFrame, pages: list[int], page_rows: int) -> DataFrame:
    """The rows of these pages.

    Few runs of pages are ranges of the id itself, which Parquet's statistics
    prune; of many, the whole extent is, and the pages (at most MAX_ROWS /
    page_rows numbers) are joined.
    """
    runs: list[list[int]] = []
    for p in sorted(pages):
        if runs and runs[-1][1] == p:
            runs[-1][1] = p + 1
        else:
            runs.append([p, p + 1])

    def within(run: list[int]) -> Column:
        return (F.col("id") >= run[0] * page_rows) & (F.col("id") < run[1] * page_rows)

    if not runs:
        return rows.where("false")
    if len(runs) <= MAX_RANGES:
        some = [within(r) for r in runs]
        while len(some) > 1:  # a balanced tree
            some = [some[i] | some[i + 1] if i + 1 < len(some) else some[i] for i in range(0, len(some), 2)]
        return rows.where(some[0])
    listed = rows.sparkSession.createDataFrame([(p,) for p in pages], "page long")
    own = rows.where(within([runs[0][0], runs[-1][1]]))
    return own.join(F.broadcast(listed), F.floor(F.col("id") / page_rows) == F.col("page"), "left_semi")


def _copies(m: Manifest) -> list[Part]:
    return [Part(p.path, p.first_page, p.last_page, list(p.replaced)) for p in m.parts]


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the rows of new in place of those with the same id."""
    fresh = new.select(F.col("id").alias("__id"), F.col("hv").alias("__hv"), F.col("inv_norm").alias("__inv"))
    return old.join(fresh, F.col("id") == F.col("__id"), "left").select("id", F.coalesce("__hv", "hv").alias("hv"), F.coalesce("__inv", "inv_norm").alias("inv_norm"))

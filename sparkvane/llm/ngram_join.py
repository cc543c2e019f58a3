"""Self-join of documents by n-gram Jaccard similarity.

1. One Arrow pass gives each document the set of its word n-grams (hashes),
   a 128-bit digest of the set, and MinHash bands.  Documents with one digest
   are copies and go on as one row, be they a million.
2. Band hashes are shuffled.  A bucket's anchor is its least class, and all
   buckets of one anchor are one group: near copies share many bands, and so one
   or two anchors, not a bucket each.  A group's classes are dealt into blocks
   of a bounded size, and every pair of blocks is a task, so no group meets
   whole in one place.  A pair belongs to the group of the first band it shares;
   a task keeps the classes that have a pair of their own in it.
3. The texts of those classes join their tasks, and a task verifies its pairs
   on the full n-gram sets by a product of 0/1 matrices.  It returns a row
   for each class, with its number of links and its least linked class, never
   a row for each pair.
4. Links' components give classes.

Bands and rows follow from the threshold and the recall at it (``plan``).

Defined results: n-grams are runs of n words between white space, case kept; a
text of fewer words has one n-gram, all of it; texts without any word (null,
empty) are one class without links to others.  Rows are told apart by doc_id
and text: a doc_id on two texts links neither to the other, and so do null
ids, which come after all others.  Groups that are not linked can have one
class_id only where a repeated or null doc_id is the least of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _runtime as rt
from . import _sieve
from ._words import mix, shingle_sets
from .components import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999  # of a pair exactly at the threshold
MAX_HASHES = 96
BLOCK = 1024  # classes of one block
BLOCK_NGRAMS = 4_000_000  # and their n-grams
EVEN_BLOCK, EVEN_BLOCKS = 256, 8  # a smaller group is cut too, into up to so many blocks of this size, to spread its work


def plan(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, and so the fewest false candidates, that meet the recall."""
    for rows in range(max_hashes, 0, -1):
        for bands in range(1, max_hashes // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    raise ValueError("no bands within max_hashes meet this recall")


class Signer:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        n = bands * rows
        self.add = mix(np.arange(1000, 1000 + n, dtype=np.uint64))[:, None]
        self.mul = mix(np.arange(5000, 5000 + n, dtype=np.uint64))[:, None] | np.uint64(1)
        self.fold = mix(np.arange(9000, 9000 + rows, dtype=np.uint64)) | np.uint64(1)
        self.salt = mix(np.arange(7000, 7000 + bands, dtype=np.uint64))

    def bands_of(self, grams: np.ndarray) -> np.ndarray:
        """One 64-bit hash for each band; none for an empty set."""
        if not len(grams):
            return np.zeros(0, np.int64)
        low = None
        for at in range(0, len(grams), 2048):
            m = ((grams[None, at : at + 2048] ^ self.add) * self.mul).min(axis=1)
            low = m if low is None else np.minimum(low, m)
        folded = (mix(low).reshape(self.bands, self.rows) * self.fold).sum(axis=1, dtype=np.uint64)
        return mix(folded + self.salt).view(np.int64)


def digest(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    if not len(grams):
        return 0, 0
    a, b = mix(grams).sum(dtype=np.uint64), mix(grams ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    return int(np.int64(a.view(np.int64))), int(np.int64(b.view(np.int64)))


def _keyed(docs: DataFrame, id_col: str, text_col: str, k1: str = "t1", k2: str = "t2") -> DataFrame:
    """docs with 128 bits of each row's doc_id and text."""
    own = F.col(id_col).cast("long"), F.col(text_col)
    return docs.withColumns({k1: F.xxhash64(*own), k2: F.xxhash64(F.lit(1), *own)})


def signatures(docs: DataFrame, words: int, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t1, t2, c1, c2, n_grams, bands) of every document."""
    rt.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for b in rt.small(batches):
            sets = shingle_sets(rt.texts(b.column(3)), words)
            keys = [digest(s) for s in sets]
            cols = [*b.columns[:3], pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([len(s) for s in sets], pa.int32())]
            cols.append(pa.array([signer.bands_of(s) for s in sets], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "t1", "t2", "c1", "c2", "n_grams", "bands"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _keyed(chosen, "doc_id", "text").select("doc_id", "t1", "t2", "text").mapInArrow(run, "doc_id long, t1 long, t2 long, c1 long, c2 long, n_grams int, bands array<long>")


def _own(t: pa.Table, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairs that share a band, the first of which belongs to the task's anchor."""
    bands, here = _matrix(t, "bands"), _matrix(t, "anchors") == t.column("anchor")[0].as_py()
    out, done = np.zeros((len(left), len(right)), bool), np.zeros((len(left), len(right)), bool)
    for k in range(bands.shape[1]):
        same = bands[left, None, k] == bands[None, right, k]
        if here[left, k].any():
            out |= same & ~done & here[left, k][:, None]
        done |= same
    return out


def _halves(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, bool]:
    """The table, its rows in the task's first and second block, and whether those are one."""
    one = t.column("i")[0].as_py() == t.column("j")[0].as_py()
    side = t.column("block").to_numpy()
    if one:
        every = np.arange(t.num_rows)
        return t, every, every, True
    return t, np.flatnonzero(side == t.column("i")[0].as_py()), np.flatnonzero(side != t.column("i")[0].as_py()), False


_TASK = ["anchor", "i", "j"]
_MEMBER = "anchor long, i int, j int, block int, c1 long, c2 long, node long, t1 long, t2 long, n_grams int, copies long, bands array<long>, anchors array<long>"
_MEMBER_NAMES = [x.strip().split(" ")[0] for x in _MEMBER.split(",")]


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    lists = t.column(name).combine_chunks()
    return lists.flatten().to_numpy().reshape(t.num_rows, -1)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each task's rows, those that have a pair of their own here."""
    for t in rt.sorted_groups(batches, _TASK):
        t, left, right, one = _halves(t)
        pairs = _own(t, left, right)
        if one:
            np.fill_diagonal(pairs, False)
        keep = np.zeros(t.num_rows, bool)
        keep[left[pairs.any(axis=1)]] = True
        keep[right[pairs.any(axis=0)]] = True
        if keep.any():
            yield from t.filter(pa.array(keep)).combine_chunks().to_batches()


def shared(a: list[np.ndarray], b: list[np.ndarray], limit: int = 1 << 23) -> np.ndarray:
    """Sizes of all intersections of a's sets with b's, as a product of 0/1 matrices over
    the n-grams that both sides have, a slice of them at a time."""
    x, y = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(x, y)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(common):
        return out

    def entries(sets: list[np.ndarray], all_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(common, all_)
        at[at == len(common)] = 0
        ok = common[at] == all_
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[ok], at[ok]

    (ra, ca), (rb, cb) = entries(a, x), entries(b, y)
    step = max(1, limit // max(len(a), len(b)))
    for lo in range(0, len(common), step):
        n = min(step, len(common) - lo)
        ma, mb = np.zeros((len(a), n), np.float32), np.zeros((len(b), n), np.float32)
        for m, r, c in ((ma, ra, ca), (mb, rb, cb)):
            here = (c >= lo) & (c < lo + n)
            m[r[here], c[here] - lo] = 1
        out += ma @ mb.T
    return out


_LINKED = "node long, links long, least long"


def _verifier(words: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in rt.sorted_groups(batches, _TASK):
            sets, want = shingle_sets(rt.texts(t.column("text")), words), list(zip(t.column("c1").to_pylist(), t.column("c2").to_pylist(), strict=True))
            own = [digest(s) == w for s, w in zip(sets, want, strict=True)]
            t = t.drop_columns(["text"]).filter(pa.array(own))
            sets = [s for s, ok in zip(sets, own, strict=True) if ok]
            if t.num_rows < 2:
                continue
            t, left, right, one = _halves(t)
            if not len(left) or not len(right):
                continue
            sizes = np.array([len(s) for s in sets], np.int64)
            both = shared([sets[k] for k in left], [sets[k] for k in right]).astype(np.int64)
            union = sizes[left][:, None] + sizes[right][None, :] - both
            linked = (both >= np.ceil(threshold * union - 1e-9)) & _own(t, left, right)
            if one:
                np.fill_diagonal(linked, False)
            node, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
            links = np.zeros(t.num_rows, np.int64)
            links[left] += linked @ copies[right]
            if not one:
                links[right] += linked.T @ copies[left]
            least = node.copy()
            while True:  # the least node that links inside this task lead to
                before = least.copy()
                for own, other, m in ((left, right, linked), (right, left, linked.T)):
                    some = m.any(axis=1)
                    low = np.where(m[some], least[other][None, :], np.iinfo(np.int64).max).min(axis=1) if some.any() else np.zeros(0, np.int64)
                    least[own[some]] = np.minimum(least[own[some]], low)
                if (before == least).all():
                    break
            out = np.flatnonzero(links > 0)
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (node, links, least)], ["node", "links", "least"])

    return run


def _grouped(docs: DataFrame, words: int, threshold: float, recall: float, id_col: str, text_col: str) -> DataFrame:
    """``join``'s columns, the row's key (t1, t2) and that of the row that stays of its group (w1, w2)."""
    spark = docs.sparkSession
    bands, rows = plan(threshold, recall)
    n = rt.partitions(spark)
    signed = rt.materialize(signatures(docs, words, bands, rows, id_col, text_col), "signatures")

    # A class's first row has the least doc_id, null after all others; its text stands for the class.
    ordered = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    grouped = signed.groupBy("c1", "c2", "n_grams").agg(F.min(ordered).alias("head"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    # A class is a node of its own, whatever its doc_id; written, the numbers stay.
    classes = rt.materialize(grouped.select("*", F.monotonically_increasing_id().alias("node")), "classes")

    # Buckets: a band's number is part of its hash.  A class has at most one anchor for each band.
    spread = classes.where("n_grams > 0").select("node", F.posexplode("bands").alias("band", "key"))
    buckets = spread.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("anchor")).where("members > 1").select(F.col("key").alias("bucket"), "anchor")
    met = spread.join(buckets, F.col("key") == F.col("bucket")).groupBy(F.col("node").alias("m_node")).agg(F.collect_list(F.struct("band", "anchor")).alias("at"))
    anchors = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda k: F.coalesce(F.get(F.filter("at", lambda x: x.getField("band") == k), F.lit(0)).getField("anchor"), F.lit(-1).cast("long")),
    )
    about = classes.select("c1", "c2", "node", F.col("head.t1").alias("t1"), F.col("head.t2").alias("t2"), "n_grams", "copies", "bands")
    members = rt.materialize(about.join(met.select("m_node", anchors.alias("anchors")), F.col("node") == F.col("m_node")).drop("m_node"), "members")

    grouped = members.select("*", F.explode(F.array_distinct(F.filter("anchors", lambda x: x >= 0))).alias("anchor"))
    sizes = grouped.groupBy(F.col("anchor").alias("group")).agg(F.count(F.lit(1)).alias("members"), F.sum("n_grams").alias("weight"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("weight") / BLOCK_NGRAMS), F.least(F.ceil(F.col("members") / EVEN_BLOCK), F.lit(EVEN_BLOCKS)))
    dealt = grouped.join(sizes.select("group", blocks.cast("int").alias("blocks")), F.col("anchor") == F.col("group"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", "anchor"), F.col("blocks")).cast("int"))
    tasks = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.select("anchor", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *_MEMBER_NAMES[3:])
    placed = tasks.repartition(n, *_TASK).sortWithinPartitions(*_TASK)
    candidates = rt.materialize(placed.mapInArrow(_candidates, _MEMBER), "candidates")

    # Only documents that may be candidates are shuffled with their texts, equal rows as one.
    wanted = candidates.select("t1").distinct()
    own = _keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", "k1", "k2").select("k1", "k2", "text")
    own, _ = _sieve.split(own, F.col("k1"), wanted, "t1", candidates.count())
    own = own.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    texts = candidates.join(own, (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2"))).select(*_MEMBER_NAMES, "text")
    verified = rt.materialize(texts.repartition(n, *_TASK).sortWithinPartitions(*_TASK).mapInArrow(_verifier(words, threshold), _LINKED), "links")
    rt.drop(candidates)
    rt.drop(members)

    found = verified.groupBy(F.col("node").alias("f_node")).agg(F.sum("links").alias("links"))
    groups = components(verified.select(F.col("node").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "g_node")
    heads = classes.select("node", "head").join(groups, F.col("node") == F.col("g_node")).groupBy(F.col("component").alias("of")).agg(F.min("head").alias("first"))
    groups = groups.join(heads, F.col("component") == F.col("of")).select("g_node", "first")
    label = classes.select(F.col("c1").alias("d1"), F.col("c2").alias("d2"), "head", "copies", "node").join(groups, F.col("node") == F.col("g_node"), "left")
    label = label.join(found, F.col("node") == F.col("f_node"), "left")
    label = label.select("d1", "d2", "head", "copies", F.coalesce("first", "head").alias("first"), F.coalesce("links", F.lit(0)).alias("links"))
    out = signed.select("doc_id", "t1", "t2", "c1", "c2").join(label, (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2")))
    return out.select(
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        (F.col("links") + F.col("copies") - 1).alias("n_links"),
        F.col("head.doc_id").alias("copy_id"),
        "copies",
        "t1",
        "t2",
        F.col("first.t1").alias("w1"),
        F.col("first.t2").alias("w2"),
    )


def join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, class_id, n_links, copy_id, copies) for each document.

    ``class_id`` is the least doc_id that links lead to, the same for all near
    duplicates of each other; ``n_links`` counts the other documents at or above
    the threshold, copies included; ``copy_id`` is the least doc_id with the same
    n-grams and ``copies`` their number.
    """
    return _grouped(docs, words, threshold, recall, id_col, text_col).select("doc_id", "class_id", "n_links", "copy_id", "copies")


def representatives(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near duplicates: of each group one row with the least doc_id stays,
    of a group without any doc_id one row."""
    with rt.passing(docs.sparkSession):
        joined = rt.materialize(_grouped(docs, words, threshold, recall, id_col, text_col), "groups", inside=False)
    k1, k2, g1, g2 = rt.unused(docs, "row1", "row2", "gone1", "gone2")
    gone = joined.where((F.col("t1") != F.col("w1")) | (F.col("t2") != F.col("w2"))).select(F.col("t1").alias(g1), F.col("t2").alias(g2)).distinct()
    again = joined.where("copies > 1").groupBy("t1", "t2").count().where("count > 1").select(F.col("t1").alias(g1), F.col("t2").alias(g2))
    repeats = again.count()
    listed = gone.unionByName(again) if repeats else gone
    # What is certainly no duplicate stays where it is; the rest meets the list by shuffle.
    unsure, sure = _sieve.split(_keyed(docs, id_col, text_col, k1, k2), F.col(k1), listed, g1, gone.count() + repeats)
    if repeats:
        unsure = unsure.dropDuplicates([k1, k2])
    kept = unsure.join(gone, (F.col(k1) == F.col(g1)) & (F.col(k2) == F.col(g2)), "left_anti")
    return kept.unionByName(sure).drop(k1, k2)

"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and their first bytes, hashed into 2**20 buckets;
a document's input is the set of its buckets, from its whole text.  A bounded
sample of labelled rows trains the machine on the driver: buckets that tell
the labels apart (likelihood ratio) get a weight and a latent vector, and the
latent vectors' products carry pairwise interactions that a linear model has
no place for.  Scoring is one Arrow pass over all texts, without a shuffle.

What the driver sees of the sample is bounded: the label counts of at most
2**20 buckets, then of each of at most MAX_TRAINING_ROWS rows those of its
buckets that were chosen, at most MAX_TERMS of them, however long its text.

Defined results: a null text is the empty text and gets the bias alone; rows
without a label, or with a null label, teach nothing; of rows with equal doc_id
one teaches, the one whose text hashes lowest; without any labelled row every
score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _runtime as rt
from ._words import PUNCTUATION, word_hashes

BUCKET_BITS = 20
PREFIXES = (4, 5)  # bytes
MAX_TRAINING_ROWS = 12_000  # the bound of the training sample, by hash of doc_id
MAX_TERMS = 4096
MIN_RATIO = 25.0  # of a term's log-likelihood ratio statistic
RANK = 8
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.02, 1e-4
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2


def buckets(texts: list[str]) -> list[np.ndarray]:
    """Of each text, its distinct term buckets."""
    hashes, offsets = word_hashes(texts, PUNCTUATION, lower=True, prefixes=PREFIXES)
    small = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    return [np.unique(small[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]


@dataclass
class Machine:
    """bias + sum of weights + sum over pairs of latent products, through a logistic."""

    terms: np.ndarray  # sorted buckets
    bias: float
    weights: np.ndarray
    latent: np.ndarray  # (terms, rank)

    def margins(self, index: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """index: positions in terms of all documents, one after another."""
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        linear, s, q = (np.zeros((len(sizes), *x.shape[1:])) for x in (self.weights, self.latent, self.latent))
        some = sizes > 0
        if some.any():
            v = self.latent[index]
            linear[some] = np.add.reduceat(self.weights[index], starts[some])
            s[some] = np.add.reduceat(v, starts[some])
            q[some] = np.add.reduceat(v * v, starts[some])
        return self.bias + linear + 0.5 * (s * s - q).sum(axis=1)

    def scorer(self):
        place = np.full(1 << BUCKET_BITS, -1, np.int32)
        place[self.terms] = np.arange(len(self.terms))

        def score(texts: list[str]) -> np.ndarray:
            hashes, offsets = word_hashes(texts, PUNCTUATION, lower=True, prefixes=PREFIXES)
            found = place[(hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)]
            hit = found >= 0
            owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
            own = np.broadcast_to(owner[:, None], found.shape)[hit]
            pair = np.unique(own.astype(np.int64) * (len(self.terms) + 1) + found[hit])
            doc, index = pair // (len(self.terms) + 1), pair % (len(self.terms) + 1)
            return _logistic(self.margins(index, np.bincount(doc, minlength=len(texts))))

        return score


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _ratio(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """The log-likelihood ratio statistic of a term's presence against the label."""
    n, total = pos + neg, n_pos + n_neg
    out = np.zeros(len(pos))
    for seen, expected in ((pos, n * (n_pos / total)), (neg, n * (n_neg / total)), (n_pos - pos, (total - n) * (n_pos / total)), (n_neg - neg, (total - n) * (n_neg / total))):
        some = seen > 0
        out[some] += 2 * seen[some] * np.log(seen[some] / expected[some])
    return out


def choose(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """The buckets that tell the labels apart best, sorted; pos and neg count rows by bucket."""
    ratio = _ratio(pos, neg, n_pos, n_neg)
    order = np.lexsort((np.arange(len(ratio)), -ratio))[:MAX_TERMS]
    strong = int((ratio[order] >= MIN_RATIO).sum())
    return np.sort(order[: max(strong, min(64, int((ratio > 0).sum())))])


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 0, terms: np.ndarray | None = None) -> Machine:
    """Train on documents' bucket sets and 0/1 labels; without terms they are chosen from these rows."""
    labels = labels.astype(np.float64)
    n_pos, n_neg = int(labels.sum()), int(len(labels) - labels.sum())
    if not len(labels) or not n_pos or not n_neg:
        bias = 0.0 if not len(labels) else (4.0 if n_pos else -4.0)
        return Machine(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, RANK)))
    size = 1 << BUCKET_BITS
    if terms is None:
        pos = np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y]), minlength=size)
        neg = np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if not y]), minlength=size)
        terms = choose(pos, neg, n_pos, n_neg)
    place = np.full(size, -1, np.int64)
    place[terms] = np.arange(len(terms))
    kept = [place[r][place[r] >= 0] for r in rows]

    rng = np.random.default_rng(seed)
    m = Machine(terms, float(np.log(n_pos / n_neg)), np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), RANK)))
    state = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in (("w", m.weights), ("v", m.latent), ("b", np.zeros(1)))}
    step = 0

    def adam(k: str, g: np.ndarray) -> np.ndarray:
        a, b = state[k]
        a += 0.1 * (g - a)
        b += 0.001 * (g * g - b)
        return RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(kept)), max(1, len(kept) // BATCH)):
            step += 1
            sizes = np.array([len(kept[i]) for i in at])
            index = np.concatenate([kept[i] for i in at])
            error = (_logistic(m.margins(index, sizes)) - labels[at]) / len(at)
            each = np.repeat(error, sizes)
            doc = np.repeat(np.arange(len(at)), sizes)
            v = m.latent[index]
            sums = np.zeros((len(at), RANK))
            np.add.at(sums, doc, v)
            gw = np.bincount(index, each, minlength=len(terms)) + DECAY * m.weights
            gv = DECAY * m.latent
            np.add.at(gv, index, each[:, None] * (sums[doc] - v))
            m.weights -= adam("w", gw)
            m.latent -= adam("v", gv)
            m.bias -= float(adam("b", np.array([error.sum()]))[0])
    return m


def fold(id_col: str):
    return F.crc32(F.col(id_col).cast("string")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Fit on at most max_rows labelled rows, none of them held out.

    The sample is the labelled rows whose ids hash lowest: the same rows however
    the tables are partitioned, and as many of them however large they are.
    """
    spark = docs.sparkSession
    rt.prepare(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("__toxic")).where("__toxic is not null and __id is not null")
    known = known.where(F.crc32(F.col("__id").cast("string")) % FOLDS != HELD_OUT).groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rt.small(batches):
            rows = pa.array([x.tolist() for x in buckets(rt.texts(b.column(1)))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), rows], ["doc_id", "toxic", "buckets"])

    texts = docs.select(F.col(id_col).cast("long").alias("__own"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    # Sixteen bytes a row and at most max_rows rows: small enough to broadcast at any scale.
    chosen = texts.join(F.broadcast(sample), F.col("__own") == F.col("__id")).select("__own", "__text", "__toxic")
    one = chosen.groupBy("__own", "__toxic").agg(F.min(F.struct(F.xxhash64("__text").alias("h"), F.col("__text").alias("t"))).alias("least"))
    with rt.passing(spark):
        taught = rt.materialize(one.select("__own", F.col("least.t").alias("__text"), "__toxic").mapInArrow(run, "doc_id long, toxic int, buckets array<int>"), "taught")
        seen = taught.select("toxic", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n")).toArrow()
        totals = taught.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
        size = 1 << BUCKET_BITS
        pos, both = np.zeros(size, np.int64), np.zeros(size, np.int64)
        at = seen.column("bucket").to_numpy()
        pos[at], both[at] = seen.column("pos").to_numpy(), seen.column("n").to_numpy()
        terms = choose(pos, both - pos, totals.pos, totals.n - totals.pos) if 0 < totals.pos < totals.n else np.zeros(0, np.int64)

        def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in rt.small(batches):
                kept = [np.intersect1d(np.asarray(x, np.int64), terms, assume_unique=True).tolist() for x in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kept, pa.list_(pa.int32()))], ["doc_id", "toxic", "buckets"])

        got = taught.mapInArrow(only, taught.schema).toArrow().sort_by("doc_id")
    lists = got.column("buckets").combine_chunks()
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    rows = [values[a:b].astype(np.int64) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
    return fit(rows, got.column("toxic").to_numpy(), terms=terms)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs' columns and, after them, toxic_score and toxic_predicted, which replace columns of these names."""
    rt.prepare(docs.sparkSession)
    added = ["toxic_score", "toxic_predicted"]
    own = [c for c in docs.columns if c.lower() not in added]
    at = own.index(text_col)
    kept = docs.select(*[F.col(f"`{c}`") for c in own])
    schema = kept.select("*", F.lit(0.0).alias(added[0]), F.lit(0).alias(added[1])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = machine.scorer()
        for b in rt.small(batches):
            s = scorer(rt.texts(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], [*own, *added])

    return kept.mapInArrow(run, schema)


def reject(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with docs' columns."""
    rt.prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = machine.scorer()
        for b in rt.small(batches):
            yield b.filter(pa.array(scorer(rt.texts(b.column(at))) < threshold))

    return docs.mapInArrow(run, docs.schema)

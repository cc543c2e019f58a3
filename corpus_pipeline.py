"""A corpus pipeline of five stages, each one of the training-data operators.

Every stage takes all that its predecessor kept, as written and reread Parquet;
all but the last return the columns of documents.

1. toxicity: documents that the factorization machine rejects go.
2. line dedup: repeated lines go, whole documents stay.
3. near duplicates: of each group of documents that the n-gram join links, one stays.
4. decontamination: documents that hold a benchmark passage go.
5. SentencePiece: token ids and their decoded text's digest.

Null columns, empty texts and repeated rows pass through the stages as each
operator defines; an empty table gives empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.llm import _runtime as rt
from sparkvane.llm import decontaminate, line_dedup, ngram_join, piece_codec, toxicity
from sparkvane.llm.queries import table, tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, machine)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs), counts=False)
    # n_chars belongs to the text that is left.
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    both = piece_codec.round_trip(docs, tokenizer_file("piece_bpe_32k.model"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]

#: A trained model's decisions cannot be written in SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with rt.passing(spark):  # what a stage writes on its way goes when its result is written
            docs = rt.materialize(stage(spark, docs, sf_dir), name, inside=False)
        rt.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

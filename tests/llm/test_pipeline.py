from __future__ import annotations

import hashlib

import corpus_pipeline as cp
import public_tokenizers
import sentencepiece
from test_line_dedup import plain as plain_lines
from test_ngram_join import plain as plain_groups

from sparkvane.llm import decontaminate, toxicity


def expected(rows, keep, items):
    """The stages by plain means; keep decides toxicity."""
    rows = [(i, t or "") for i, t in rows if keep(t)]
    lines = plain_lines(rows)
    rows = [(i, lines[i]) for i, _ in rows]
    groups = plain_groups(rows)
    rows = [(i, t) for i, t in rows if groups[i][2] == i]
    rows = [(i, t) for i, t in rows if not any(x in t.lower() for x in items)]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return {i: (len(ids := lib.encode(t)), ids, hashlib.sha256(lib.decode(ids).encode()).hexdigest()) for i, t in rows}


def rows_of(df):
    return {r.doc_id: (r.n_tokens, r.ids, r.decoded_sha256) for r in df.collect()}


def test_against_plain_stages(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{d}/documents.parquet")
    machine = toxicity.train(source, spark.read.parquet(f"{d}/labels.parquet"))
    scorer = machine.scorer()
    rows = [(r.doc_id, r.text) for r in source.collect()]
    items = [decontaminate.folded(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = rows_of(cp.run(spark, d))
    assert got == expected(rows, lambda t: scorer([t or ""])[0] < toxicity.THRESHOLD, items)
    assert 0 < len(got) < len(rows)


def test_stages_keep_the_columns_and_do_their_work(spark, tmp_path):
    shared = "this line stands in several documents of the corpus"
    leak = "the benchmark passage that nobody should ever train on, word for word"
    near = " ".join(f"w{i}" for i in range(80))
    texts = [
        f"first own words\n{shared}", f"second own words\n{shared}", near, near.replace("w40 ", "x40 "), near, f"before {leak} after", None, "", "clean text that stays as it is",
    ]
    rows = [(i, t, "en", None if i == 2 else "src", 0 if t is None else len(t)) for i, t in enumerate(texts)] + [(None, "a row without an id", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = f"file://{tmp_path}"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        seen.append({r.doc_id: r.text for r in out.collect()})
        docs = out
    assert seen[0].keys() == {*range(9), None}
    assert seen[1][0].endswith(shared) and seen[1][1] == "second own words"
    assert seen[1][4] == ""  # its only line stands in document 2, so it is as empty as 6 and 7 now
    assert seen[2].keys() == {0, 1, 2, 4, 5, 8, None}
    assert seen[3].keys() == {0, 1, 2, 4, 8, None}
    assert rows_of(cp.run(spark, sf)).keys() == seen[3].keys()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, f"file://{tmp_path}").count() == 0

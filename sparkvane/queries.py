"""The query catalog over the driver's tables, with an SQL oracle for each query that has one."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.half import to_half_bytes
from .functions.vectors import cosine, l2_norm, let, unit_query
from .limits import MAX_K, padded
from .operators.corpus import Corpus
from .operators.exclusions import Exclusions
from .operators.grouping import best_per_group, collapse, top_groups
from .operators.ranking import score_batch, top_k
from .operators.search import PreparedSearch, Searcher
from .plans.profile import overlap, stage_counts
from .sources.ingest import bad_padded_rows
from .sources.scratch import scratch_path

DIMENSIONS = 64
BATCH = 8

# Shared pieces


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus.build(vectors(spark, sf_dir), DIMENSIONS)


def first_vectors(spark: SparkSession, sf_dir: str, n: int) -> list[list[float]]:
    return [r.v for r in vectors(spark, sf_dir).where(F.col("id") < n).orderBy("id").collect()]


def rounded(df: DataFrame, column: str = "similarity") -> DataFrame:
    return df.withColumn(column, F.round(F.col(column).cast("double"), 6))


# The oracle's own arithmetic, in DuckDB


def _half(x: str) -> str:
    unit = f"pow(2.0::DOUBLE, floor(log2(abs({x}))) - 10)"
    return (
        f"CASE WHEN {x} = 0 THEN 0.0::DOUBLE WHEN abs({x}) < 0.00006103515625 THEN round_even({x} * 16777216.0::DOUBLE, 0) / 16777216.0::DOUBLE "
        f"ELSE round_even({x} / {unit}, 0) * {unit} END"
    )


def _fold(values: str) -> str:
    return f"list_reduce(list_prepend(0.0::DOUBLE, {values}), lambda a, b: a + b)"


def _squares(v: str) -> str:
    return _fold(f"list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE)")


def _dot(a: str, b: str) -> str:
    return _fold(f"list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)")


def _corpus_of(source: str) -> str:
    return f"""unit AS (SELECT id, v, list_transform(v, lambda x: x::DOUBLE / l) AS nv FROM (SELECT id, v, sqrt({_squares("v")}) AS l FROM ({source}))),
quant AS (SELECT id, v, nv, list_transform(nv, lambda x: ({_half("x")})::FLOAT) AS hv FROM unit),
corpus AS (SELECT id, v, hv, (1.0::DOUBLE / sqrt({_squares("hv")}))::FLOAT AS inv FROM quant)"""


_SOURCE = "SELECT vec_id AS id, embedding AS v FROM embeddings"
_CORPUS = _corpus_of(_SOURCE)


def _queries(n: int, half: bool, where: str = "") -> str:
    q = f"list_transform(nv, lambda x: ({_half('x::FLOAT::DOUBLE')})::FLOAT)" if half else "list_transform(nv, lambda x: x::FLOAT)"
    return f"qs AS (SELECT id AS qid, {q} AS q FROM unit WHERE id < {n} {where})"


_SCORED = f"scored AS (SELECT qid, c.id, ({_dot('hv', 'q')} * inv::DOUBLE)::FLOAT AS s FROM corpus c, qs)"


def _ranked(k: int, source: str = "scored") -> str:
    return f"best AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rk, id, s FROM {source} QUALIFY rk <= {k})"


_SIM = "round(s::DOUBLE, 6) AS similarity"


def _batch_sql(n: int, k: int, keep: str = "true", half: bool = True) -> str:
    return f"WITH {_CORPUS}, {_queries(n, half)}, {_SCORED}, {_ranked(k, f'(SELECT * FROM scored WHERE {keep})')} SELECT qid, rk, id, {_SIM} FROM best"


def _single_sql(k: int, keep: str = "true", query: int = 0) -> str:
    return (
        f"WITH {_CORPUS}, {_queries(query + 1, False, f'AND id = {query}')}, {_SCORED}, {_ranked(k, f'(SELECT * FROM scored WHERE {keep})')} "
        f"SELECT rk, id, {_SIM} FROM best"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Building


@_query(f"SELECT vec_id AS id, round(sqrt({_squares('embedding')}), 9) AS norm FROM embeddings")
def build_l2_norm(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", F.round(l2_norm(F.col("v")), 9).alias("norm"))


@_query(f"WITH {_CORPUS} SELECT id, unnest(range(len(hv))) AS pos, unnest(hv)::DOUBLE AS component FROM corpus")
def build_quantized(spark, sf_dir):
    return corpus(spark, sf_dir).df.select("id", F.posexplode("hv").alias("pos", "component")).select("id", F.col("pos").cast("long"), F.col("component").cast("double"))


@_query(f"WITH {_CORPUS} SELECT id, inv::DOUBLE AS inv_norm FROM corpus")
def build_inverse_norm(spark, sf_dir):
    return corpus(spark, sf_dir).df.select("id", F.col("inv_norm").cast("double"))


@_query(f"WITH {_CORPUS} SELECT id, sum(h::DOUBLE) AS total, any_value(inv)::DOUBLE AS inv_norm FROM (SELECT id, inv, unnest(hv) AS h FROM corpus) GROUP BY id")
def build_fp16_preserved(spark, sf_dir):
    """Binary16 bytes in, the same components out; sums of binary16 values this small are exact."""
    halves = to_half_bytes(corpus(spark, sf_dir).df.select("id", F.col("hv").alias("v")))
    built = Corpus.build_half(halves, DIMENSIONS)
    return built.df.select("id", F.aggregate("hv", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"), F.col("inv_norm").cast("double"))


@_query("SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 7 = 0) AS bad_rows")
def import_padded_validate(spark, sf_dir):
    """Padded rows, every seventh with something in its padding."""
    extra = F.array_repeat(F.lit(0.0).cast("float"), padded(DIMENSIONS) - DIMENSIONS - 1)
    last = F.array(F.when(F.col("id") % 7 == 0, 1.0).otherwise(0.0).cast("float"))
    rows = corpus(spark, sf_dir).df.select("id", F.concat("hv", extra, last).alias("v"))
    return bad_padded_rows(rows, DIMENSIONS)


@_query(f"WITH {_CORPUS}, {_queries(1, False)}, {_SCORED} SELECT id, {_SIM} FROM scored")
def import_padded_scores(spark, sf_dir):
    """The corpus adopted from two padded shards scores as the built one."""
    rows = corpus(spark, sf_dir).df.select("id", F.concat("hv", F.array_repeat(F.lit(0.0).cast("float"), padded(DIMENSIONS) - DIMENSIONS)).alias("v"))
    cut = 100
    shards = [rows.where(F.col("id") < cut).select(F.col("id").alias("pos"), "v"), rows.where(F.col("id") >= cut).select((F.col("id") - cut).alias("pos"), "v")]
    return rounded(Searcher(Corpus.adopt(spark, shards, DIMENSIONS)).scores(first_vectors(spark, sf_dir, 1)[0]))


@_query("SELECT vec_id AS id FROM embeddings")
def insertion_ids(spark, sf_dir):
    """Rows without ids get dense ones."""
    return Corpus.build(vectors(spark, sf_dir).select("v"), DIMENSIONS, id_col=None).df.select("id")


# Searching


@_query(f"WITH {_CORPUS}, {_queries(1, False)}, {_SCORED} SELECT id, {_SIM} FROM scored")
def scores_all(spark, sf_dir):
    return rounded(Searcher(corpus(spark, sf_dir)).scores(first_vectors(spark, sf_dir, 1)[0]))


@_query(_single_sql(10))
def search_top10(spark, sf_dir):
    return rounded(Searcher(corpus(spark, sf_dir)).search(first_vectors(spark, sf_dir, 1)[0], 10))


@_query(_single_sql(1024))
def search_top1024(spark, sf_dir):
    return rounded(Searcher(corpus(spark, sf_dir)).search(first_vectors(spark, sf_dir, 1)[0], 1024))


#: IDs around the powers of two, where bitmaps change words, some of them twice.
_EXCLUDED = [2**k + d for k in range(8) for d in (-1, 0, 1)]
_KEPT = f"id NOT IN ({', '.join(map(str, sorted(set(_EXCLUDED))))})"


@_query(_single_sql(10, _KEPT))
def search_excluding(spark, sf_dir):
    return rounded(Searcher(corpus(spark, sf_dir)).search(first_vectors(spark, sf_dir, 1)[0], 10, _EXCLUDED))


@_query(_batch_sql(BATCH, 5))
def search_batch_top5(spark, sf_dir):
    return rounded(Searcher(corpus(spark, sf_dir)).search_batch(first_vectors(spark, sf_dir, BATCH), 5))


@_query(_batch_sql(60, 5))
def search_batch_60(spark, sf_dir):
    return rounded(Searcher(corpus(spark, sf_dir)).search_batch(first_vectors(spark, sf_dir, 60), 5))


@_query(_batch_sql(60, 5))
def search_batch_60_sql(spark, sf_dir):
    """The same by expressions alone."""
    return rounded(Searcher(corpus(spark, sf_dir), engine="sql").search_batch(first_vectors(spark, sf_dir, 60), 5))


@_query(_batch_sql(BATCH, 5, _KEPT))
def search_batch_excluding(spark, sf_dir):
    return rounded(Searcher(corpus(spark, sf_dir)).search_batch(first_vectors(spark, sf_dir, BATCH), 5, _EXCLUDED))


@_query(_batch_sql(2, 1024))
def search_large_k_exceeding_rows(spark, sf_dir):
    """k above the row count of the smaller tables: all rows, ranked."""
    return rounded(Searcher(corpus(spark, sf_dir)).search_batch(first_vectors(spark, sf_dir, 2), 1024))


@_query(
    f"""WITH {_CORPUS}, {_queries(4, True)}, {_SCORED}, {_ranked(3)}, asked AS (SELECT unnest(range(6)) AS qid)
SELECT a.qid::BIGINT AS qid, (a.qid >= 4)::INT AS status, count(b.id)::INT AS count, coalesce(min(b.id) FILTER (WHERE rk = 1), -1) AS first_id
FROM asked a LEFT JOIN best b ON b.qid = a.qid GROUP BY a.qid"""
)
def device_search_status(spark, sf_dir):
    """Queries computed upstream with a stride gap; a zero one and one with NaN fail alone."""
    good = vectors(spark, sf_dir).where("id < 4").select(F.col("id").alias("qid"), F.concat("v", F.array(F.lit(float("nan")).cast("float"))).alias("q"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), DIMENSIONS)
    bad = F.concat(F.array(F.lit(float("nan")).cast("float")), F.array_repeat(F.lit(1.0).cast("float"), DIMENSIONS - 1))
    queries = good.unionByName(spark.range(1).select(F.lit(4).cast("long").alias("qid"), zero.alias("q"))).unionByName(spark.range(1).select(F.lit(5).cast("long").alias("qid"), bad.alias("q")))
    found = Searcher(corpus(spark, sf_dir)).search_frame(queries, 3)
    return found.select("qid", "status", "count", F.coalesce(F.try_element_at("neighbors", F.lit(1)).getField("id"), F.lit(-1).cast("long")).alias("first_id"))


#: Scores by the number of bits in which ID and query differ: all kinds of special values, and many ties.
_SPECIAL = """CASE bits WHEN 1 THEN 'Infinity'::FLOAT WHEN 2 THEN '-Infinity'::FLOAT WHEN 3 THEN 'NaN'::FLOAT
 WHEN 5 THEN (CASE WHEN id % 2 = 0 THEN 0.0 ELSE -0.0 END)::FLOAT ELSE (bits - 5)::FLOAT END"""


@_query(
    f"""WITH bits AS (SELECT q.range AS qid, i.range AS id, bit_count(xor(i.range, q.range)) AS bits FROM range(3) q, range(700) i),
scored AS (SELECT qid, id, {_SPECIAL} AS s FROM bits),
{_ranked(40, "(SELECT * FROM scored WHERE NOT isnan(s) AND s > '-Infinity'::FLOAT)")} SELECT qid, rk, id FROM best"""
)
def topk_custom_scores(spark, sf_dir):
    """A score matrix with NaN, infinities, signed zeros and many ties."""

    def value(i):
        bits = F.bit_count(i.bitwiseXOR(F.col("id").cast("int")))
        zero = F.when(i % 2 == 0, 0.0).otherwise(-0.0)
        return F.when(bits == 1, float("inf")).when(bits == 2, float("-inf")).when(bits == 3, float("nan")).when(bits == 5, zero).otherwise(bits - 5).cast("float")

    matrix = spark.range(3).select(F.col("id").alias("qid"), F.transform(F.sequence(F.lit(0), F.lit(699)), value).alias("scores"))
    return top_k(score_batch(matrix, 700), 40).select("qid", "rk", "id")


@_query("SELECT o_custkey AS qid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk, o_orderkey AS id, o_totalprice::DOUBLE AS score FROM orders QUALIFY rk <= 3")
def topk_orders_by_customer(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("score"))
    return top_k(rows, 3).select("qid", "rk", "id", "score")


@_query("SELECT user_id AS qid, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rk, event_id AS id, value::DOUBLE AS score FROM events QUALIFY rk <= 2")
def topk_events_by_user(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("id"), F.col("value").cast("double").alias("score"))
    return top_k(rows, 2).select("qid", "rk", "id", "score")


# Gathering, grouping, joining

#: Some rows in no order, the first of them twice more.
_GATHERED = (lambda ids: ids + ids[:2])(random.Random(41).sample(range(100), 9))


@_query(
    f"""WITH {_CORPUS}, asked AS (SELECT unnest(range({len(_GATHERED)})) AS pos, unnest({_GATHERED}) AS id)
SELECT a.pos, a.id::BIGINT AS id, unnest(range(len(hv))) AS place, round(unnest(list_transform(hv, lambda h: (h::DOUBLE * inv::DOUBLE)::FLOAT))::DOUBLE, 9) AS component
FROM asked a JOIN corpus c ON c.id = a.id"""
)
def gather_rows(spark, sf_dir):
    got = corpus(spark, sf_dir).gather(_GATHERED)
    return got.select("pos", "id", F.posexplode("v").alias("place", "component")).select("pos", "id", F.col("place").cast("long"), F.round(F.col("component").cast("double"), 9).alias("component"))


_SUBSETS = (list(range(19, -1, -1)), list(range(39, 19, -1)))


@_query(
    f"""WITH {_CORPUS}, g AS (SELECT id, list_transform(hv, lambda h: (h::DOUBLE * inv::DOUBLE)::FLOAT) AS v FROM corpus WHERE id < 40),
scored AS (SELECT 19 - a.id AS qid, 39 - b.id AS id, ({_dot("a.v", "b.v")})::FLOAT AS s FROM g a, g b WHERE a.id < 20 AND b.id >= 20), {_ranked(1)}
SELECT 19 - qid AS left_id, 39 - id AS right_id, {_SIM} FROM best"""
)
def subset_scores_best(spark, sf_dir):
    """Dense block scores of two gathered subsets by place, each left row's best right one, and both places back to IDs."""
    own = corpus(spark, sf_dir)
    left, right = (own.gather(ids) for ids in _SUBSETS)
    one = F.lit(1.0).cast("float")
    block = left.select(F.col("pos").alias("qid"), F.col("v").alias("a")).crossJoin(F.broadcast(right.select(F.col("pos").alias("id"), F.col("v").alias("b"))))  # 20 rows
    best = top_k(block.select("qid", "id", cosine(F.col("b"), one, F.col("a")).alias("similarity")), 1, score="similarity")
    names = [spark.createDataFrame(list(enumerate(ids)), f"{place} long, {name} long") for ids, place, name in zip(_SUBSETS, ("qid", "id"), ("left_id", "right_id"), strict=True)]
    return rounded(best.join(F.broadcast(names[0]), "qid").join(F.broadcast(names[1]), "id").select("left_id", "right_id", "similarity"))  # 20 rows each


def _album(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    own = corpus(spark, sf_dir)
    q = spark.createDataFrame(list(enumerate(first_vectors(spark, sf_dir, 3))), "qid long, q array<float>").select("qid", unit_query(F.col("q"), True).alias("q"))
    scores = own.df.crossJoin(F.broadcast(q)).select("qid", "id", cosine(F.col("hv"), F.col("inv_norm"), F.col("q")).alias("score"))  # three queries
    ordinals = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("album"))
    return scores, ordinals, spark.range(11).withColumnRenamed("id", "album")


_ALBUM = f"""WITH {_CORPUS}, {_queries(3, True)}, {_SCORED},
albums AS (SELECT qid, label AS album, max(s) AS s FROM scored JOIN embeddings e ON e.vec_id = scored.id GROUP BY ALL),
grid AS (SELECT qid, unnest(range(11)) AS album FROM qs)"""


@_query(f"{_ALBUM} SELECT g.qid, g.album, coalesce(round(a.s::DOUBLE, 6), -2) AS score, a.s IS NULL AS empty FROM grid g LEFT JOIN albums a ON a.qid = g.qid AND a.album = g.album")
def album_best(spark, sf_dir):
    """Best score of each query in each album; album 10 has no rows."""
    best = best_per_group(*_album(spark, sf_dir))
    empty = F.col("score") == float("-inf")
    return best.select("qid", "album", F.when(empty, -2.0).otherwise(F.round(F.col("score").cast("double"), 6)).alias("score"), empty.alias("empty"))


@_query(f"{_ALBUM} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY s DESC, album) AS rk, album::BIGINT AS album FROM albums QUALIFY rk <= 4")
def album_topk(spark, sf_dir):
    return top_groups(best_per_group(*_album(spark, sf_dir)), 4).select("qid", "rk", "album")


@_query(
    f"""WITH {_CORPUS}, {_queries(BATCH, True)}, {_SCORED}, {_ranked(MAX_K)},
firsts AS (SELECT best.*, label FROM best JOIN embeddings e ON e.vec_id = best.id QUALIFY row_number() OVER (PARTITION BY qid, label ORDER BY rk) = 1)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rk) AS slot, id, label::BIGINT AS album FROM firsts QUALIFY slot <= 5"""
)
def collapse_by_label(spark, sf_dir):
    found = Searcher(corpus(spark, sf_dir)).search_batch(first_vectors(spark, sf_dir, BATCH), MAX_K)
    ordinals = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("album"))
    return collapse(found, ordinals, 5).select("qid", "slot", "id", "album")


@_query(f"WITH {_CORPUS}, {_queries(1, False)}, {_SCORED}, {_ranked(10)} SELECT rk, d.doc_id AS external_id, d.source FROM best JOIN documents d ON d.doc_id = best.id")
def external_id_join(spark, sf_dir):
    found = Searcher(corpus(spark, sf_dir)).search(first_vectors(spark, sf_dir, 1)[0], 10)
    names = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("external_id"), "source")
    return found.join(names, found["id"] == names["external_id"]).select("rk", "external_id", "source")


def _walk_sql(steps: int) -> str:
    """Every step's scan spelled out, without the rows of the steps before."""
    parts = [_CORPUS, _queries(1, False), "q0 AS (SELECT q FROM qs)"]
    for n in range(steps):
        seen = " AND ".join(["true", *(f"c.id <> (SELECT id FROM w{m})" for m in range(n))])
        parts.append(f"w{n} AS (SELECT id, hv FROM (SELECT c.id, c.hv, ({_dot('c.hv', 'q.q')} * c.inv::DOUBLE)::FLOAT AS s FROM corpus c, q{n} q WHERE {seen}) ORDER BY s DESC, id LIMIT 1)")
        parts.append(f"q{n + 1} AS (SELECT list_transform(hv, lambda x: (x::DOUBLE / l)::FLOAT) AS q FROM (SELECT hv, sqrt({_squares('hv')}) AS l FROM w{n}))")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT {n}::BIGINT AS step, id FROM w{n}" for n in range(steps))


@_query(_walk_sql(6))
def similarity_walk(spark, sf_dir):
    own = corpus(spark, sf_dir)
    own.persist()
    steps = Searcher(own).walk(first_vectors(spark, sf_dir, 1)[0], 6)
    own.unpersist()
    return spark.createDataFrame([(n, i) for n, i in enumerate(steps)], "step long, id long")


@_query(
    """SELECT vec_id AS id FROM embeddings
WHERE vec_id IN (1, 5) OR vec_id % 3 = 0 AND NOT (vec_id >= 30 AND vec_id % 2 = 0) AND NOT (vec_id >= 12 AND vec_id % 4 = 0)"""
)
def exclusion_set_ops(spark, sf_dir):
    """Lists and frames in and out; IDs beyond the corpus count in frames alone, where they are ignored."""
    rows = len(corpus(spark, sf_dir))
    ex = Exclusions(spark, rows)
    ex.insert(range(100, 130))
    ex.clear()
    ex.insert_frame(spark.range(0, rows + 50, 3))
    ex.remove(range(30, rows, 2))
    ex.remove_frame(spark.range(12, rows + 12, 4))
    ex.insert([1, 1, 5])
    return ex.df


# Mutations


def _stored(spark: SparkSession, c: Corpus, page_rows: int = 128) -> Corpus:
    return c.save(scratch_path(spark, "corpus"), page_rows)


_NEW = "SELECT vec_id AS id, list_transform(embedding, lambda x: -x) AS v FROM embeddings WHERE vec_id < 30"
_MUTATED = f"{_queries(1, False)}, {_SCORED}, {_ranked(10)} SELECT rk, id, {_SIM} FROM best"


def _negated(spark, sf_dir, n: int) -> DataFrame:
    return vectors(spark, sf_dir).where(F.col("id") < n).select("id", F.transform("v", lambda x: -x).alias("v"))


@_query(f"WITH {_corpus_of(f'{_SOURCE} UNION ALL SELECT id + (SELECT count(*) FROM embeddings), v FROM ({_NEW})')}, {_MUTATED}")
def append_search(spark, sf_dir):
    """Search after an append of thirty negated rows; the first row's nearest stay, its opposite is new."""
    grown = _stored(spark, corpus(spark, sf_dir)).append(_negated(spark, sf_dir, 30), id_col="id")
    return rounded(Searcher(grown).search(first_vectors(spark, sf_dir, 1)[0], 10))


@_query(f"WITH {_corpus_of(f'SELECT vec_id AS id, CASE WHEN vec_id < 30 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS v FROM embeddings')}, " + _MUTATED.replace("AS q FROM unit", "AS q FROM (SELECT id, list_transform(nv, lambda x: -x) AS nv FROM unit)"))
def update_search(spark, sf_dir):
    changed = _stored(spark, corpus(spark, sf_dir)).update(_negated(spark, sf_dir, 30))
    return rounded(Searcher(changed).search(first_vectors(spark, sf_dir, 1)[0], 10))


@_query(f"WITH {_CORPUS}, {_MUTATED}")
def compact_search(spark, sf_dir):
    """Two updates that undo each other, then compaction."""
    base = _stored(spark, corpus(spark, sf_dir))
    back = base.update(_negated(spark, sf_dir, 30)).update(vectors(spark, sf_dir).where("id < 30"))
    return rounded(Searcher(back.compact()).search(first_vectors(spark, sf_dir, 1)[0], 10))


@_query("SELECT 'base' AS snapshot, count(*) AS n FROM embeddings UNION ALL SELECT 'left', count(*) + 5 FROM embeddings UNION ALL SELECT 'right', count(*) + 6 FROM embeddings")
def snapshot_isolation(spark, sf_dir):
    """Two appends from one base: each sees its own rows, the base none."""
    base = _stored(spark, corpus(spark, sf_dir)).fork()
    left, right = base.append(_negated(spark, sf_dir, 5), id_col="id"), base.append(_negated(spark, sf_dir, 6), id_col="id")
    out = None
    for name, c in (("base", base), ("left", left), ("right", right)):
        one = c.df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("snapshot"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@_query(f"WITH {_CORPUS} SELECT id, unnest(range(len(hv))) AS pos, unnest(hv)::DOUBLE AS component, inv::DOUBLE AS inv_norm FROM corpus")
def save_load_roundtrip(spark, sf_dir):
    saved = _stored(spark, corpus(spark, sf_dir))
    parts = Corpus.load(spark, saved.store.path).df.select("id", F.posexplode("hv").alias("pos", "component"), "inv_norm")
    return parts.select("id", F.col("pos").cast("long"), F.col("component").cast("double"), F.col("inv_norm").cast("double"))


def _as_halves(rows: DataFrame) -> DataFrame:
    """The rows' encoded components, as binary16 bytes."""
    return to_half_bytes(Corpus.build(rows, DIMENSIONS).df.select("id", F.col("hv").alias("v")))


@_query(f"WITH {_corpus_of(f'{_SOURCE} UNION ALL SELECT id + (SELECT count(*) FROM embeddings), v FROM ({_NEW})')}, {_MUTATED}")
def append_half_search(spark, sf_dir):
    """The same appended as binary16 bytes."""
    grown = _stored(spark, corpus(spark, sf_dir)).append(_as_halves(_negated(spark, sf_dir, 30)), half=True, id_col="id")
    return rounded(Searcher(grown).search(first_vectors(spark, sf_dir, 1)[0], 10))


@_query(ORACLES["update_search"])
def update_half_search(spark, sf_dir):
    changed = _stored(spark, corpus(spark, sf_dir)).update(_as_halves(_negated(spark, sf_dir, 30)), half=True)
    return rounded(Searcher(changed).search(first_vectors(spark, sf_dir, 1)[0], 10))


@_query(
    f"""WITH {_CORPUS}, {_queries(BATCH, True)}, {_SCORED}, {_ranked(4)}
SELECT qid, 0 AS status, 4 AS count, list({_SIM.split(" AS ")[0]} ORDER BY rk)::VARCHAR AS scores, list(id ORDER BY rk)::VARCHAR AS ids FROM best GROUP BY qid"""
)
def prepared_search(spark, sf_dir):
    """Status, counts, scores and ids of a prepared search's fixed-shape results."""
    with PreparedSearch(Searcher(corpus(spark, sf_dir)), BATCH, 4).submit(first_vectors(spark, sf_dir, BATCH)) as found:
        df = found.df
    as_list = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    near = F.transform("scores", lambda x: F.round(x.cast("double"), 6).cast("string"))
    return df.select("qid", "status", "count", as_list(near).alias("scores"), as_list(F.col("ids").cast("array<string>")).alias("ids"))


# Reports


@_query(
    f"""WITH {_CORPUS}, {_queries(20, True)}, {_SCORED}, {_ranked(10)},
plain AS (SELECT u.id AS qid, c.id, {_dot("u.nv", "c.nv")} AS s FROM unit u, unit c WHERE u.id < 20),
exact AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rk, id FROM plain QUALIFY rk <= 10)
SELECT e.qid, count(b.id) / 10 AS overlap FROM exact e LEFT JOIN best b ON b.qid = e.qid AND b.id = e.id GROUP BY e.qid"""
)
def quantization_overlap(spark, sf_dir):
    """Share of each query's exact top ten that the quantized corpus finds."""
    v = vectors(spark, sf_dir)
    unit = v.select("id", let(l2_norm(F.col("v")), lambda norm: F.transform("v", lambda x: x.cast("double") / norm)).alias("nv"))
    q = unit.where("id < 20").select(F.col("id").alias("qid"), F.col("nv").alias("q"))
    total = F.aggregate(F.zip_with("nv", "q", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    exact = top_k(unit.crossJoin(F.broadcast(q)).select("qid", "id", total.alias("score")), 10)  # twenty queries
    return overlap(exact, Searcher(corpus(spark, sf_dir)).search_batch(first_vectors(spark, sf_dir, 20), 10), 10)


@_query(f"WITH {_CORPUS} SELECT id, sum(h::DOUBLE) AS checksum FROM (SELECT id, unnest(hv) AS h FROM corpus) GROUP BY id")
def read_control(spark, sf_dir):
    return Searcher(corpus(spark, sf_dir)).read_control()


@_query("SELECT count(*) * 128 AS vectors, count(*) * 4 AS norms, count(*) * 132 AS total FROM embeddings")
def memory_report(spark, sf_dir):
    m = corpus(spark, sf_dir).memory_usage()
    return spark.createDataFrame([(m.vectors, m.norms, m.total)], "vectors long, norms long, total long")


@_query(
    "SELECT * FROM (VALUES (3::BIGINT, 1::BIGINT, 66560::BIGINT, 67080::BIGINT), (3, 257, 133120, 266760), (384, 0, 0, 0)) t(dimensions, count, resident_bytes, peak_bytes)"
)
def build_memory(spark, sf_dir):
    shapes = ((3, 1), (3, 257), (384, 0))
    rows = [(d, n, (m := Corpus.build_memory(d, n)).resident_bytes, m.peak_bytes) for d, n in shapes]
    return spark.createDataFrame(rows, "dimensions long, count long, resident_bytes long, peak_bytes long")


@_query()
def profile_stage_counts(spark, sf_dir):
    return stage_counts(Searcher(corpus(spark, sf_dir)).search_batch(first_vectors(spark, sf_dir, BATCH), 5))


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """Flagship: a batch of eight searches, five neighbours each."""
    return search_batch_top5(spark, sf_dir)

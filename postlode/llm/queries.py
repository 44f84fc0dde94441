"""The queries of this subpackage: one op<N>_<name> for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlode.llm import ann, clusters, langid, lm, mixing, packing, quality, resampling, secrets, sharding, simhash, topk, toxicity
from postlode.llm.common import crc_bucket, rows_of


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: fixed patterns and sliding-window entropy."""
    return secrets.scan(rows_of(spark, sf_dir, "documents"))


def op2_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight contiguous shards of nearly equal bytes."""
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return sharding.shard_by_bytes(rows_of(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", law, "shard", "slot", grown
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels that are not held out."""
    docs = rows_of(spark, sf_dir, "documents")
    held = quality.held_out(F.col("doc_id"))
    trees = quality.learn(docs, rows_of(spark, sf_dir, "labels"), ~held)
    return quality.score(docs, trees).select("doc_id", held.alias("held_out"), "score", "predicted")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from documents that are not held out."""
    docs = rows_of(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"))
    field = langid.learn(docs, ~held)
    return langid.predict(docs, field).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 1024 tokens, packed into sequences."""
    return packing.pack_documents(rows_of(spark, sf_dir, "documents"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a bigram model of the documents that are not held out."""
    docs = rows_of(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 5) == 1, F.lit(False))
    scored = lm.train_and_score(docs, held_out)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"
    )


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources at weights 1, 2, 3, ... takes of each document."""
    mixed = mixing.mix(rows_of(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every 20th vector with all others."""
    return topk.top_k(rows_of(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found by cosine for every 50th vector among all others."""
    return ann.nearest(rows_of(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(rows_of(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty centroids of the vectors after five rounds, and each vector's own."""
    return clusters.cluster(rows_of(spark, sf_dir, "embeddings"), k=40, rounds=5, width=64, scale=256.0, salt="2:")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents of 20 words and more, drawn towards the benchmark's words and word pairs."""
    drawn = resampling.resample(rows_of(spark, sf_dir, "documents"), rows_of(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, by voters and labels that are not held out."""
    docs = rows_of(spark, sf_dir, "documents")
    held = toxicity.held_out(F.col("doc_id"))
    model = toxicity.learn(docs, rows_of(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_byte_shards": op2_byte_shards,
        "op3_quality": op3_quality,
        "op4_language": op4_language,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_kneser_ney": op6_kneser_ney,
        "op7_source_mix": op7_source_mix,
        "op8_exact_top_k": op8_exact_top_k,
        "op9_nearest_neighbours": op9_nearest_neighbours,
        "op10_simhash_near_duplicates": op10_simhash_near_duplicates,
        "op11_centroid_clusters": op11_centroid_clusters,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_toxicity": op13_toxicity,
    }


OP8_SQL = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, x -> CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), p -> p[1] * p[2])) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """Lloyd rounds written out one after another over (vector, centroid) rows."""
    nearest = """a{r} AS MATERIALIZED (
    SELECT i, arg_min(n, d * 64 + n) AS n, min(d) AS d FROM (
        SELECT x.i, c.n, CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
        FROM x, c{r} c) GROUP BY i
)"""
    moved = """c{s} AS MATERIALIZED (
    WITH e AS (SELECT n, unnest(v) AS y, unnest(range(64)) AS j FROM a{r} JOIN x USING (i)),
    m AS (SELECT n, j, CAST(sum(y) AS BIGINT) AS t, count(*) AS q FROM e GROUP BY n, j),
    f AS (SELECT n, list((t - ((t % q) + q) % q) // q ORDER BY j) AS v FROM m GROUP BY n)
    SELECT c.n, coalesce(f.v, c.v) AS v FROM c{r} c LEFT JOIN f USING (n)
)"""
    steps = [step.format(r=r, s=r + 1) for r in range(rounds) for step in (nearest, moved)] + [nearest.format(r=rounds)]
    return f"""
WITH x AS MATERIALIZED (
    SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda y: CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h, v) - 1 AS n, v FROM (
        SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, v FROM x WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k})
), {", ".join(steps)}
SELECT x.vec_id, CAST(n AS INTEGER) AS cluster, a.d AS distance,
       CAST(sum(a.d) OVER (PARTITION BY n) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN x USING (i) JOIN c{rounds} c USING (n)
"""


#: CRC-32 bit by bit and byte by byte over the different features; every other step is plain grouping.
OP12_SQL = r"""
WITH steps AS MATERIALIZED (
    SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS step
), texts AS MATERIALIZED (
    SELECT 'd' AS side, row_number() OVER () AS i, doc_id, text FROM documents
    UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark
), words AS MATERIALIZED (
    SELECT side, i, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM texts
), held AS MATERIALIZED (
    SELECT side, i, f, count(*) AS n FROM (
        SELECT side, i, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM words)
    GROUP BY side, i, f
), hexed AS (
    SELECT f, hex(f) AS x FROM (SELECT DISTINCT f FROM held)
), bytes AS (
    SELECT f, list_transform(range(len(x) // 2), lambda k:
        16 * (instr('0123456789ABCDEF', x[2 * k + 1]) - 1) + instr('0123456789ABCDEF', x[2 * k + 2]) - 1) AS b
    FROM hexed
), bucketed AS MATERIALIZED (
    SELECT f, xor(4294967295, list_reduce(b, lambda c, y: xor(c // 256, step[xor(c % 256, y) + 1]), 4294967295)) % 10000 AS bucket
    FROM bytes, steps
), sums AS MATERIALIZED (
    SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 't') AS t FROM held JOIN bucketed USING (f) GROUP BY bucket
), gains AS MATERIALIZED (
    SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
        / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce(sum(t) OVER (), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain
    FROM sums
), weighed AS (
    SELECT i, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS g
    FROM held JOIN bucketed USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY i
), scored AS MATERIALIZED (
    SELECT i, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0) AS weight,
           coalesce((g - ((g % n) + n) % n) // n, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM (SELECT *, CAST('0x' || substr(sha256('7:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM words WHERE side = 'd')
    LEFT JOIN weighed USING (i)
), able AS (
    SELECT i, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank, count(*) OVER () AS n FROM scored
    WHERE n_words >= 20 AND doc_id IS NOT NULL
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CAST(CASE WHEN rank <= 25 * n // 100 THEN rank END AS BIGINT) AS rank
FROM scored LEFT JOIN able USING (i)
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_top_k": OP8_SQL, "op11_centroid_clusters": _op11_sql(), "op12_importance_resampling": OP12_SQL}

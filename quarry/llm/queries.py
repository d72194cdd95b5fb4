"""The queries of this package, with their production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .clusters import clustered
from .lines import told
from .media import stored_media
from .mixing import taken
from .nearness import near_groups
from .packing import pack
from .quality import judged as quality_judged
from .secrets import scan_secrets
from .sharding import minimax_shards
from .topk import nearest
from .toxicity import judged
from .wavelet import read_shards, write_shards
from .whitening import whitened


def vocabulary() -> str:
    """Where the byte-level vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table. Documents that lie in fewer files than there are cores are dealt to all of them; larger tables have more files, and nothing is moved."""
    df, cores = spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if table == "documents" and len(df.inputFiles()) < cores else df


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards(read(spark, sf_dir, "documents"), n_shards=24)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), vocabulary(), size=2048, end=0)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(read(spark, sf_dir, "documents"), shards=16, weights=(1, 2, 3), ceiling=3)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_media(read(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"), size=3, percent=85).drop("key", "root")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(read(spark, sf_dir, "documents"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(read(spark, sf_dir, "documents"), vocabulary(), end=0))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read(spark, sf_dir, "embeddings"), components=16, scale=64, shift=1_000_000, weight="one")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(read(spark, sf_dir, "embeddings"), clusters=40, rounds=5, width=64, scale=256, seed=2).drop("evaluated")


def _rounds(clusters: int, rounds: int, width: int, scale: int, seed: int) -> str:
    """All distances in every round, in SQL."""
    assigned = """
        d{r} AS MATERIALIZED (SELECT k.line, c.number, CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept k, c{r} c),
        a{r} AS MATERIALIZED (SELECT line, arg_min(number, (d, number)) AS number, min(d) AS d FROM d{r} GROUP BY line),"""
    moved = """
        s{r} AS (SELECT number, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.number, unnest(k.v) AS x, generate_subscripts(k.v, 1) AS pos FROM a{r} a JOIN kept k USING (line)) GROUP BY number, pos),
        m{r} AS (SELECT number, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS v FROM s{r} GROUP BY number),
        c{n} AS MATERIALIZED (SELECT c.number, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (number)),"""
    steps = "".join(assigned.format(r=r) + (moved.format(r=r, n=r + 1) if r < rounds else "") for r in range(rounds + 1))
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS line, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, vec_id, v) - 1 AS number, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, vec_id, v FROM kept ORDER BY h NULLS LAST, vec_id, v LIMIT {clusters})),{steps}
        i AS (SELECT number, CAST(sum(d) AS BIGINT) AS inertia FROM a{rounds} GROUP BY number)
        SELECT k.vec_id, CAST(a.number AS INTEGER) AS cluster, a.d AS distance, i.inertia AS cluster_inertia, (SELECT CAST(sum(inertia) AS BIGINT) FROM i) AS inertia,
            sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN kept k USING (line) JOIN i USING (number) JOIN c{rounds} c USING (number)"""


QUERIES = {f.__name__: f for f in (op1_sharding, op2_secret_scans, op3_best_fit_packing, op4_source_mixing, op5_media_columns, op6_minhash_near_dedup, op7_toxicity, op8_line_dedup, op9_exact_top_k, op10_token_files, op11_quality_classifier, op12_embedding_whitening, op13_centroid_clustering)}
ORACLES = {
    "op9_exact_top_k": """
        WITH fine AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM fine q JOIN fine c ON c.vec_id <> q.vec_id
            WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op13_centroid_clustering": _rounds(clusters=40, rounds=5, width=64, scale=256, seed=2),
}

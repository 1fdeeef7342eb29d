"""Queries of this subpackage: name -> (spark, folder) -> DataFrame, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandloom.llm import (
    centroids,
    chat,
    decontamination,
    html_text,
    jaccard,
    lengths,
    negatives,
    pieces,
    secrets,
    suffixes,
    token_files,
    topk,
    toxicity,
)
from demandloom.llm.common import table
from demandloom.sources.staging import new_folder, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return secrets.scan(docs, secrets.train(docs))


@query
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    lexicon = toxicity.train(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, lexicon).select(
        "doc_id",
        F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = lengths.token_counts(table(spark, folder, "documents"))
    return lengths.context_limits(stage(lengths.histogram(counts), "lengths"))


@query
def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(  # conversation -7 of the contract
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return chat.digests(chat.format_conversations(conversations.unionByName(extra)))


# The template of chat.render as SQL: frames of 19 characters a turn, escapes where a text needs them.
_NEEDS = " OR ".join(
    f"contains({c}, '{mark}')" for c in ("role", "text") for mark in ("\\", *chat.CONTROLS)
)


def _sql_escape(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for control in chat.CONTROLS:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


ORACLES["op5_chat_format"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), c AS (
  SELECT *, bool_or({_NEEDS}) OVER (PARTITION BY conv_id) AS escaped FROM t
), g AS (
  SELECT conv_id, any_value(escaped) AS escaped, count(*) AS n,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(3 + 7 + 8 + 4 + CASE WHEN escaped THEN length({_sql_escape("role")}) + length({_sql_escape("text")})
        ELSE length(role) + length(text) END) AS chars
  FROM c GROUP BY conv_id
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256,
  CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars,
  escaped, true AS round_trips
FROM g"""


@query
def op6_pivot_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, 10)


ORACLES["op6_pivot_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""


@query
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    model = pieces.Pieces.load()
    docs = table(spark, folder, "documents")
    return pieces.round_trips(docs, model)


@query
def op1_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, folder, "documents"))


@query
def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, folder, "documents")).drop("kept")


@query
def op8_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_text(table(spark, folder, "pages"))


@query
def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster(table(spark, folder, "embeddings")))


def _centroid_sql(k: int = centroids.CENTROIDS, rounds: int = centroids.ROUNDS) -> str:
    """Plain nearest-centroid rounds: all distances, smallest (distance, number)."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(e) AS e, min(struct_pack(d := d, j := j)) AS b FROM (
    SELECT v.rid, v.vec_id, v.e, c.j,
      CAST(list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i]))) AS BIGINT) AS d
    FROM v, c{r} c) GROUP BY rid
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.j, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN (
    SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM (
      SELECT j, i, sum(x) AS s, count(*) AS n FROM (
        SELECT b.j AS j, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{r}) GROUP BY j, i) GROUP BY j
  ) m USING (j)
)""")
    chain = ", ".join(steps)
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)) NULLS LAST, e) - 1 AS j, e FROM v QUALIFY j < {k}
), {chain}
SELECT vec_id, CAST(b.j AS INTEGER) AS cluster, b.d AS distance,
  CAST(sum(b.d) OVER (PARTITION BY b.j) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.e, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.j = b.j"""


ORACLES["op11_centroids"] = _centroid_sql()


@query
def op12_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "token-ids")
    token_files.write(table(spark, folder, "documents"), path)
    return token_files.summary(token_files.open_file(spark, path))


@query
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.whole_rows(table(spark, folder, "embeddings"), label), F.col("vec_id") % 100 == 0)


ORACLES["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, min(struct_pack(label := label, e := e)) AS r FROM (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND label IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  ) GROUP BY vec_id
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.r.label = c.r.label AS same,
    CAST(list_sum(list_transform(range(1, least(len(a.r.e), len(c.r.e)) + 1), lambda i: a.r.e[i] * c.r.e[i])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""

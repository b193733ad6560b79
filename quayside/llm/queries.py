"""The corpus operators' queries, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, compression, decontamination, html_template, jaccard_join, mixing, pii, quality, secrets, sharding


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf_dir, "documents"))


def op2_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract_articles(table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document and test item."""
    found = decontamination.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("score", F.round("score", 6)).distinct()


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations, and one (-7) whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), F.col("id").cast("int") + 1).alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.format_logs(chat.table_events(rows)))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op9_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compression_rules(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source").withColumn("target", F.round("target", 6))


QUERIES = {f.__name__: f for f in (op1_pii, op2_html_template, op3_quality, op4_sharding, op5_decontamination, op6_chat, op7_jaccard_join, op8_secrets, op9_compression, op10_mixing)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP6 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|><|im_sep|><|im_end|>') + length(regexp_replace(role, '([<\[␛])', '\1␛', 'g')) + length(regexp_replace(text, '([<\[␛])', '\1␛', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

_OP7 = (
    r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS shingle FROM s), n AS (SELECT doc_id, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, m.c AS component_id FROM n JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = n.doc_id
"""
)

_OP10 = (
    r"""
WITH d AS (SELECT doc_id, source, len({words})::BIGINT AS size,
  -ln((('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE) / ((length(translate(coalesce(text, ''), '#*$%&|<>!', '')) + 1)::DOUBLE / (length(coalesce(text, '')) + 1)) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::DOUBLE * 1.5 AS total FROM s),
v AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
m AS (SELECT first(level ORDER BY cap / weight, source NULLS LAST) AS met FROM v WHERE level * weight < cap),
t AS (SELECT source, source_size, CASE WHEN met IS NULL THEN cap ELSE least(cap, met * weight) END AS target FROM v, m),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS epochs FROM t),
o AS (SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, (size * (epochs + CASE WHEN before + size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM o
"""
)

ORACLES = {"op6_chat": _OP6, "op7_jaccard_join": _OP7, "op10_mixing": _OP10.replace("{words}", _WORDS)}

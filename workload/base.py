"""The tables as the engine's inputs, in Spark and as SQL."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkrec.functions.prompts import expansion_system

_EXPANSIONS = {expansion_system(kind, 4): kind for kind in ("hyde", "step_back", "fusion")}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def collection(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, with a vector where there is one. The language stands for the category."""
    docs = table(spark, sf, "documents").withColumn("text_hash", F.sha2("text", 256))
    vectors = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    meta = F.create_map(
        F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"),
        F.lit("label"), F.col("label").cast("string"), F.lit("categories"), F.col("lang"))
    return docs.join(vectors, "doc_id", "left").select(
        F.lit("papers").alias("collection"), "doc_id", F.col("text").alias("document"),
        meta.alias("meta"), F.col("lang").alias("category"), "text_hash",
        "embedding", "lang", "source", "label")


def variants(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector is a query variant; five in a row belong to one query."""
    vec = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        F.floor(vec / 5).cast("long").alias("query_id"), (vec % 5).cast("int").alias("variant_no"),
        "embedding")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Question texts for the query ids of `variants`."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "text")


def user_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """What users typed. Some get blanks at both ends."""
    rows = table(spark, sf, "conversations").where("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "conv_id", "text")
    padded = F.concat(F.lit(" \t"), "text", F.lit("\u00a0\n"))
    return rows.withColumn("text", F.when(F.col("query_id") % 5 == 0, padded).otherwise(F.col("text")))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- SQL of the same inputs -----------------------------------------------------

SQL_INPUTS = """
q AS (SELECT vec_id // 5 AS query_id, (vec_id % 5)::INT AS variant_no, embedding::DOUBLE[] AS qv
      FROM embeddings),
c AS (SELECT d.doc_id, d.text AS document, d.lang, d.source, e.label, e.embedding::DOUBLE[] AS dv
      FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""

SQL_SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def sql_strip(c: str) -> str:
    inner = f"regexp_replace({c}, '^[{SQL_SPACE}]+', '')"
    return f"regexp_replace({inner}, '[{SQL_SPACE}]+$', '')"


def sql_hits(n: int, condition: str = "true", metric: str = "l2sq", variants: str = "q") -> str:
    dist = {"l2sq": "pow(list_distance(qv, dv), 2)", "cosine": "1 - list_cosine_similarity(qv, dv)",
            "ip": "1 - list_inner_product(qv, dv)"}[metric]
    return f"""
pairs AS (SELECT {variants}.query_id, {variants}.variant_no, c.doc_id, {dist} AS distance
          FROM {variants} JOIN c ON dv IS NOT NULL AND ({condition})),
top AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY distance, doc_id)::INT AS rank
           FROM pairs QUALIFY rank <= {n}),
hits AS MATERIALIZED (SELECT v.* EXCLUDE (qv), c.* EXCLUDE (dv), top.distance, top.rank FROM top
           JOIN {variants} v ON v.query_id = top.query_id AND v.variant_no = top.variant_no JOIN c ON c.doc_id = top.doc_id)"""


SQL_MERGED = """
seen AS (SELECT *, row_number() OVER (PARTITION BY query_id, document ORDER BY variant_no, rank) AS nth FROM hits),
merged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY variant_no, rank)::INT AS pos
           FROM seen WHERE nth = 1),
chunked AS (SELECT *, ((pos - 1) // 5 + 1)::INT AS chunk_index, ((pos - 1) % 5 + 1)::INT AS doc_no FROM merged)"""


# --- stand-ins for models: plain functions of the text -----------------------------

def stand_in_answer(system: str, prompt: str, model: str) -> str:
    """A digest of the prompt; one prompt in sixteen fails."""
    digest = hashlib.sha256(prompt.encode()).hexdigest()
    if digest.endswith("0"):
        raise RuntimeError("no answer")
    return "answer " + digest


def stand_in_model(system: str, prompt: str, model: str) -> str:
    """Expansions made from a digest of their prompt, and answers as above."""
    kind = _EXPANSIONS.get(system)
    if kind is None:
        return stand_in_answer(system, prompt, model)
    digest = hashlib.sha256(prompt.encode()).hexdigest()
    if kind == "hyde":
        return "passage " + digest[:12]
    if kind == "step_back":
        return json.dumps({"abstracted_query": "about " + digest[:12], "categories": [], "confidence": "high"})
    return json.dumps(["way " + digest[:6], "way " + digest[6:12], "passage " + digest[:12]])


def stand_in_vectors(texts: list[str]) -> list[list[float]]:
    """Eight numbers out of a digest of the text."""
    out = []
    for text in texts:
        digest = hashlib.sha256(text.encode()).hexdigest()
        out.append([int(digest[i:i + 4], 16) / 65535 for i in range(0, 32, 4)])
    return out


def stand_in_scores(pairs: list[tuple[str, str]]) -> list[float]:
    return [float((len(q) * 7 + len(d)) % 101) for q, d in pairs]


def stand_in_rerank(query: str, documents: list[str], top_n: int) -> list[tuple[int, float]]:
    if len(query) % 10 == 0:
        raise RuntimeError("service down")
    scores = stand_in_scores([(query, d) for d in documents])
    order = sorted(range(len(documents)), key=lambda i: -scores[i])
    return [(i, scores[i]) for i in order[:top_n]]

"""Merging, chunking, prompts, whole runs, confidence and faithfulness."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrec import constants as K
from sparkrec.config import Params
from sparkrec.operators import chunk, confidence, evaluate, merge
from sparkrec.operators.events import fold_events
from sparkrec.operators.knn import knn_topk
from sparkrec.operators.models import embed_texts, stream_tokens
from sparkrec.plans.answer import chunk_requests
from sparkrec.plans.recommend import recommend, run_events, run_pipeline
from sparkrec.plans.retrieve import among, attach_documents
from sparkrec.sources.prompts import as_queries, read_prompts
from sparkrec.sources.results import write_json, write_parquet
from sparkrec.storage import cut_lineage, scratch_path
from workload.base import (
    SQL_INPUTS, SQL_MERGED, collection, questions, quoted, sql_hits, sql_strip, stand_in_answer,
    stand_in_model, stand_in_vectors, table, user_prompts, variants,
)

CHUNK = 5
_SQL_BASE = f"WITH {SQL_INPUTS}, {sql_hits(20)}, {SQL_MERGED}"


def _hits(spark, sf, n=20):
    return knn_topk(variants(spark, sf), collection(spark, sf), n, carry=["text_hash"])


def first_seen(spark, sf):
    return merge.merge_first_seen(_hits(spark, sf)).select("query_id", "pos", "variant_no", "rank", "doc_id")


def rrf(spark, sf):
    fused = merge.merge_rrf(_hits(spark, sf))
    return fused.select("query_id", "pos", "doc_id", F.round("rrf_score", 9).alias("rrf_score"))


_SQL_RRF = f"""WITH {SQL_INPUTS}, {sql_hits(20)},
best AS (SELECT query_id, document, variant_no, min(rank) AS rank, arg_min(doc_id, rank) AS doc_id FROM hits
         GROUP BY query_id, document, variant_no),
fused AS (SELECT query_id, document, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(doc_id) AS doc_id
          FROM best GROUP BY query_id, document)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS pos, doc_id,
       round(score, 9) AS rrf_score FROM fused"""


def not_seen(spark, sf):
    """What the first variant did not return, of all the variants returned."""
    hits = cut_lineage(_hits(spark, sf), "hits")  # read twice; the search runs once
    rest = merge.not_seen_before(merge.merge_first_seen(hits), hits.where("variant_no = 0"))
    return rest.select("query_id", "doc_id")


def _merged(spark, sf, n=20):
    return cut_lineage(merge.merge_first_seen(_hits(spark, sf, n)).select("query_id", "pos", "doc_id"), "merged")


def _chunks(spark, sf, merged=None):
    merged = merged or _merged(spark, sf)
    return chunk.assemble_chunks(attach_documents(merged, collection(spark, sf), kept=True), CHUNK)


def _requests(spark, sf, n=20):
    """Prompts of the chunks; of the questions those with hits are read."""
    merged = _merged(spark, sf, n)
    return chunk_requests(among(questions(spark, sf), "query_id", merged), _chunks(spark, sf, merged))


def chunks(spark, sf):
    docs = F.col("docs")
    return _chunks(spark, sf).select(
        "query_id", "chunk_index", "num_docs_in_chunk",
        F.array_join(F.transform(docs, lambda d: d["doc_id"].cast("string")), ",").alias("doc_ids"),
        F.array_join(F.transform(docs, lambda d: d["doc_no"].cast("string")), ",").alias("doc_nos"),
        F.aggregate(docs, F.lit(0).cast("long"), lambda a, d: a + F.length(d["document"])).alias("n_chars"))


def summary(spark, sf):
    """Every document's id as a query; most have no hits and stay with zeros."""
    asked = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"))
    return chunk.query_summary(asked, merge.merge_first_seen(_hits(spark, sf)), CHUNK)


def chunk_prompts(spark, sf):
    rows = _requests(spark, sf)
    return rows.select("query_id", "chunk_index", F.sha2("prompt", 256).alias("prompt_hash"),
                       F.length("prompt").alias("n_chars"), "cache_key")


def _sql_literal(template: str) -> list[str]:
    return [quoted(part) for part in template.replace("%d", "%s").split("%s")]


_DOC = _sql_literal(K.DOCUMENT_BLOCK)
_USER = _sql_literal(K.ANSWER_USER)
_SQL_PROMPTS = f"""
blocks AS (SELECT query_id, chunk_index, count(*)::INT AS n,
           string_agg({_DOC[0]} || doc_no || {_DOC[1]} || document || {_DOC[2]}, chr(10) ORDER BY pos) AS context
           FROM chunked GROUP BY query_id, chunk_index),
prompts AS (SELECT blocks.*, {_USER[0]} || d.text || {_USER[1]} || chunk_index || {_USER[2]} || context || {_USER[3]} AS prompt
            FROM blocks JOIN documents d ON d.doc_id = query_id)"""


def recommendations(spark, sf):
    result = recommend(questions(spark, sf), collection(spark, sf), stand_in_answer,
                       Params(top_k=5), variants=variants(spark, sf))
    return shown_results(result)


def recommend_json(spark, sf):
    """The results written as JSON and as Parquet, and read back by their schema."""
    result = recommend(questions(spark, sf), collection(spark, sf), stand_in_answer, Params(top_k=5), variants=variants(spark, sf))
    kept, path, other = cut_lineage(result, "results"), scratch_path(spark, "json"), scratch_path(spark, "parquet")
    write_json(kept, path)
    write_parquet(kept, other)
    back = spark.read.schema(kept.schema)
    return shown_results(back.json(path)).withColumn("sink", F.lit("json")).union(
        shown_results(back.parquet(other)).withColumn("sink", F.lit("parquet")))


def recommend_prompts(spark, sf):
    """Questions out of prompt files without ids, a third of them asked twice: expansion,
    embedding, search, merge and answers. Every request has the same result as its repeat."""
    asked = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", F.col("text").alias("input_prompt"))
    path = scratch_path(spark, "prompts")
    asked.unionByName(asked.where("conv_id % 3 = 0")).select("input_prompt").write.json(path)
    queries = as_queries(read_prompts(spark, path))
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("document"),
                                                F.create_map(F.lit("lang"), F.col("lang")).alias("meta"))
    papers = cut_lineage(embed_texts(docs, stand_in_vectors))
    result = recommend(queries, papers, stand_in_model, Params(top_k=5), embed=stand_in_vectors)
    return shown_results(result.withColumn("query_id", F.xxhash64("query"))).drop("query_id")


def shown_results(result):
    rows = result.select("query_id", F.length("query").alias("n_query"), "total_docs_retrieved", "num_chunks",
                         "chunk_size", F.explode_outer("responses").alias("r"))
    texts = F.array_join(F.transform("r.docs", lambda d: d["document"]), "|")
    return rows.select(
        "query_id", "n_query", "total_docs_retrieved", "num_chunks", "chunk_size", "r.chunk_index",
        "r.num_docs_in_chunk", "r.generated_response", F.sha2(texts, 256).alias("docs_hash"))


def _sql_prompt(template: str) -> str:
    before, after = template.split("%s")
    return f"{quoted(before)} || text || {quoted(after)}"


_SQL_RECOMMEND_PROMPTS = f"""WITH
a AS (SELECT text FROM conversations WHERE role = 'user' UNION ALL
      SELECT text FROM conversations WHERE role = 'user' AND conv_id % 3 = 0),
asked AS (SELECT text, count(*) AS times, row_number() OVER (ORDER BY text) AS query_id FROM a GROUP BY text),
x AS (SELECT *, sha256(text) AS h1, sha256({_sql_prompt(K.STEP_BACK_USER)}) AS h2, sha256({_sql_prompt(K.FUSION_USER)}) AS h3 FROM asked),
raw AS (SELECT query_id, 0 AS k, text FROM x UNION ALL SELECT query_id, 1, 'passage ' || substr(h1, 1, 12) FROM x
      UNION ALL SELECT query_id, 2, 'about ' || substr(h2, 1, 12) FROM x UNION ALL SELECT query_id, 3, {sql_strip("text")} FROM x
      UNION ALL SELECT query_id, 4, 'way ' || substr(h3, 1, 6) FROM x
      UNION ALL SELECT query_id, 5, 'way ' || substr(h3, 7, 6) FROM x UNION ALL SELECT query_id, 6, 'passage ' || substr(h3, 1, 12) FROM x),
once AS (SELECT query_id, text, min(k) AS k FROM raw WHERE text <> '' GROUP BY query_id, text),
v AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY k) - 1 AS variant_no, sha256(replace(text, chr(10), ' ')) AS h FROM once),
q AS (SELECT query_id, variant_no, list_transform(range(1, 33, 4), lambda i: (('0x' || substr(h, i, 4))::INT / 65535.0)::FLOAT)::DOUBLE[] AS qv FROM v),
dh AS (SELECT doc_id, text AS document, sha256(replace(text, chr(10), ' ')) AS h FROM documents),
c AS (SELECT doc_id, document, list_transform(range(1, 33, 4), lambda i: (('0x' || substr(h, i, 4))::INT / 65535.0)::FLOAT)::DOUBLE[] AS dv FROM dh),
{sql_hits(5)}, {SQL_MERGED}, {_SQL_PROMPTS.replace("documents d ON d.doc_id = query_id", "asked d ON d.query_id = blocks.query_id")},
docs AS (SELECT query_id, chunk_index, sha256(string_agg(document, '|' ORDER BY pos)) AS docs_hash
         FROM chunked GROUP BY query_id, chunk_index),
totals AS (SELECT query_id, count(*) AS total, max(chunk_index) AS chunks FROM chunked GROUP BY query_id)
SELECT length(d.text)::INT AS n_query, total AS total_docs_retrieved, chunks AS num_chunks, 5 AS chunk_size, p.chunk_index,
       p.n AS num_docs_in_chunk, CASE WHEN right(sha256(p.prompt), 1) = '0'
            THEN '[Error generating response for chunk ' || p.chunk_index || ']'
            ELSE 'answer ' || sha256(p.prompt) END AS generated_response, docs.docs_hash
FROM (SELECT *, unnest(range(times)) AS again FROM asked) d JOIN totals ON totals.query_id = d.query_id
JOIN prompts p ON p.query_id = d.query_id JOIN docs ON docs.query_id = p.query_id AND docs.chunk_index = p.chunk_index"""


_SQL_RUN = f"WITH {SQL_INPUTS}, {sql_hits(5)}, {SQL_MERGED}, {_SQL_PROMPTS}"
_SQL_RECOMMEND = _SQL_RUN + f""",
docs AS (SELECT query_id, chunk_index, sha256(string_agg(document, '|' ORDER BY pos)) AS docs_hash
         FROM chunked GROUP BY query_id, chunk_index),
totals AS (SELECT query_id, count(*) AS total, max(chunk_index) AS chunks FROM chunked GROUP BY query_id)
SELECT d.doc_id AS query_id, length(d.text)::INT AS n_query, coalesce(total, 0) AS total_docs_retrieved,
       coalesce(chunks, 0) AS num_chunks, 5 AS chunk_size, p.chunk_index, p.n AS num_docs_in_chunk,
       CASE WHEN p.prompt IS NULL THEN NULL WHEN right(sha256(p.prompt), 1) = '0'
            THEN '[Error generating response for chunk ' || p.chunk_index || ']'
            ELSE 'answer ' || sha256(p.prompt) END AS generated_response,
       docs.docs_hash
FROM documents d LEFT JOIN totals ON totals.query_id = d.doc_id LEFT JOIN prompts p ON p.query_id = d.doc_id
LEFT JOIN docs ON docs.query_id = p.query_id AND docs.chunk_index = p.chunk_index"""


def run_event_log(spark, sf):
    """The event log a run makes, without its wall times."""
    run = run_pipeline(questions(spark, sf), collection(spark, sf), stand_in_answer, Params(top_k=5),
                       variants=variants(spark, sf))
    return shown_events(run_events(run))


def shown_events(log):
    return log.select("query_id", "seq", "type", "step", "status", "message", "count",
                      "num_chunks", "chunk_index", "num_docs_in_chunk",
                      F.size("docs").alias("n_docs"), "total_docs_retrieved", "chunk_size")


_SQL_EVENTS = _SQL_RUN + f""",
t AS (SELECT d.doc_id AS query_id, coalesce(n.total, 0) AS total, coalesce(n.chunks, 0) AS chunks, coalesce(v.n, 0) AS nv
      FROM documents d
      LEFT JOIN (SELECT query_id, count(*) AS total, max(chunk_index) AS chunks FROM chunked GROUP BY query_id) n ON n.query_id = d.doc_id
      LEFT JOIN (SELECT query_id, count(*) AS n FROM q GROUP BY query_id) v ON v.query_id = d.doc_id),
ev AS (
  SELECT query_id, 1 AS a, 0 AS b, 0 AS p, 'progress' AS type, 'variants' AS step, 'start' AS status, {quoted(K.MSG_VARIANTS_START)} AS message,
         NULL::BIGINT AS count, NULL::INT AS num_chunks, NULL::INT AS chunk_index, NULL::INT AS num_docs_in_chunk, NULL::INT AS n_docs,
         NULL::BIGINT AS total_docs_retrieved, NULL::INT AS chunk_size FROM t
  UNION ALL SELECT query_id, 2, 0, 0, 'progress', 'variants', 'done', 'Generated ' || nv || ' query variants', nv, NULL, NULL, NULL, NULL, NULL, NULL FROM t
  UNION ALL SELECT query_id, 3, 0, 0, 'progress', 'retrieval', 'start', 'Retrieving documents across ' || nv || ' queries...', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM t
  UNION ALL SELECT query_id, 4, 0, 0, 'progress', 'retrieval', 'done', 'Retrieved ' || total || ' unique documents', total, NULL, NULL, NULL, NULL, NULL, NULL FROM t
  UNION ALL SELECT query_id, 5, 0, 0, 'progress', 'chunking', 'done', 'Split ' || total || ' docs into ' || chunks || ' chunk(s) of at most 5', NULL, chunks, NULL, NULL, NULL, NULL, NULL FROM t WHERE total > 0
  UNION ALL SELECT query_id, 6, chunk_index, 1, 'chunk_start', NULL, NULL, NULL, NULL, NULL, chunk_index, n, NULL, NULL, NULL FROM prompts
  UNION ALL SELECT query_id, 6, chunk_index, 3, 'chunk_end', NULL, NULL, NULL, NULL, NULL, chunk_index, n, n, NULL, NULL FROM prompts
  UNION ALL SELECT query_id, 7, 0, 0, 'complete', NULL, NULL, NULL, NULL, chunks, NULL, NULL, NULL, total, CASE WHEN total > 0 THEN 5 END FROM t)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY a, b, p) AS seq, type, step, status, message, count,
       num_chunks, chunk_index, num_docs_in_chunk, n_docs, total_docs_retrieved, chunk_size FROM ev"""


def _tokens(system, prompt, model):
    """The answer's digest in pieces of eight; one prompt in sixteen fails at once."""
    text = stand_in_answer(system, prompt, model)
    for i in range(0, len(text), 8):
        yield text[i:i + 8]


def token_stream(spark, sf):
    return stream_tokens(_requests(spark, sf, 5), _tokens)


def streamed_events(spark, sf):
    """The log of a run with its tokens, folded back into chunks."""
    run = run_pipeline(questions(spark, sf), collection(spark, sf), stand_in_answer, Params(top_k=5),
                       variants=variants(spark, sf))
    tokens = stream_tokens(chunk_requests(questions(spark, sf), run.chunks), _tokens)
    folded, _, _ = fold_events(cut_lineage(run_events(run, tokens), "log"))  # read three times; the model runs once
    return folded.select("query_id", "chunk_index", "num_docs_in_chunk", F.size("docs").alias("n_docs"),
                         "generated_response", "status", "streaming")


def confidence_parts(spark, sf):
    """User prompts; a conversation's vector stands for those of its prompts."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("conv_id"), "embedding")
    asked = user_prompts(spark, sf).join(vectors, "conv_id")
    docs = collection(spark, sf)
    hits = knn_topk(asked, docs, 5, "cosine", keys=["query_id"])
    scored = confidence.confidence(asked, attach_documents(hits, docs, columns=("document",)),
                                   Params(confidence_threshold=0.55))
    return scored.select("query_id", *[F.round(c, 6).alias(c) for c in ("similarity", "consistency", "overlap")],
                         "confidence", "use_collection")


_SQL_CONFIDENCE = f"""
WITH {SQL_INPUTS},
u AS (SELECT conv_id * 1000 + turn AS query_id, 0 AS variant_no, text, embedding::DOUBLE[] AS qv
      FROM conversations JOIN embeddings ON conv_id = vec_id WHERE role = 'user'),
{sql_hits(5, metric='cosine', variants='u')},
g AS (SELECT query_id, any_value(text) AS text, 1 - min(distance) AS top, avg(1 - distance) AS mean,
             string_agg(lower(document), ' ' ORDER BY rank) AS corpus FROM hits GROUP BY query_id),
w AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS terms FROM g),
p AS (SELECT query_id, greatest(0, least(1, top)) AS similarity,
             CASE WHEN top <= 0 THEN 0 ELSE greatest(0, least(1, mean / top)) END AS consistency,
             CASE WHEN len(terms) = 0 THEN 0 ELSE len(list_filter(terms, lambda t: contains(corpus, t))) / len(terms) END AS overlap FROM w)
SELECT query_id, round(similarity, 6) AS similarity, round(consistency, 6) AS consistency, round(overlap, 6) AS overlap,
       round(0.5::DOUBLE * similarity + 0.3::DOUBLE * consistency + 0.2::DOUBLE * overlap, 4) AS confidence,
       round(0.5::DOUBLE * similarity + 0.3::DOUBLE * consistency + 0.2::DOUBLE * overlap, 4) >= 0.55 AS use_collection FROM p"""


def _claims(spark, sf):
    """One claim per labelled document of a chunk, supported when it is not toxic."""
    merged = merge.merge_first_seen(_hits(spark, sf))
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    rows = chunk.number_chunks(merged, CHUNK).join(labels, "doc_id", "left")
    return rows.select(
        "query_id", "chunk_index",
        F.when(F.col("toxic").isNotNull(), F.col("doc_id").cast("string")).alias("claim"),
        F.when(F.col("toxic") == 0, "YES").when(F.col("toxic") == 1, "NO").alias("verdict"),
        (F.col("toxic") == 0).alias("supported"))


def faithfulness(spark, sf):
    scores = evaluate.chunk_faithfulness(_claims(spark, sf))
    return scores.withColumn("faithfulness_score", F.round("faithfulness_score", 6))


def faithfulness_per_query(spark, sf):
    scores = evaluate.aggregate_faithfulness(evaluate.chunk_faithfulness(_claims(spark, sf)))
    return scores.withColumn("aggregate_faithfulness", F.round("aggregate_faithfulness", 6))


_SQL_CLAIMS = _SQL_BASE + """,
claims AS (SELECT query_id, chunk_index, toxic FROM chunked LEFT JOIN labels USING (doc_id)),
scores AS (SELECT query_id, chunk_index, count(toxic) AS total_claims, count(*) FILTER (WHERE toxic = 0) AS supported_claims,
           CASE WHEN count(toxic) > 0 THEN count(*) FILTER (WHERE toxic = 0) / count(toxic) END AS score
           FROM claims GROUP BY query_id, chunk_index)"""

QUERIES = {
    "merge_first_seen": first_seen,
    "merge_rrf": rrf,
    "not_seen_before": not_seen,
    "chunk_docs": chunks,
    "query_summary": summary,
    "chunk_prompts": chunk_prompts,
    "recommend": recommendations,
    "recommend_json": recommend_json,
    "recommend_prompts": recommend_prompts,
    "run_events": run_event_log,
    "token_stream": token_stream,
    "streamed_events": streamed_events,
    "confidence_parts": confidence_parts,
    "faithfulness": faithfulness,
    "faithfulness_per_query": faithfulness_per_query,
}

ORACLE = {
    "recommend_prompts": _SQL_RECOMMEND_PROMPTS,
    "recommend_json": f"SELECT r.*, unnest(['json', 'parquet']) AS sink FROM ({_SQL_RECOMMEND}) r",
    "merge_first_seen": _SQL_BASE + " SELECT query_id, pos, variant_no, rank, doc_id FROM merged",
    "merge_rrf": _SQL_RRF,
    "not_seen_before": f"""WITH {SQL_INPUTS}, {sql_hits(20)},
        g AS (SELECT query_id, document, min(variant_no) AS v, arg_min(doc_id, variant_no * 1000 + rank) AS doc_id FROM hits GROUP BY query_id, document)
        SELECT query_id, doc_id FROM g WHERE v > 0""",
    "chunk_docs": _SQL_BASE + """ SELECT query_id, chunk_index, count(*)::INT AS num_docs_in_chunk,
        string_agg(doc_id::VARCHAR, ',' ORDER BY pos) AS doc_ids, string_agg(doc_no::VARCHAR, ',' ORDER BY pos) AS doc_nos,
        sum(length(document))::BIGINT AS n_chars FROM chunked GROUP BY query_id, chunk_index""",
    "query_summary": _SQL_BASE + """ SELECT d.doc_id AS query_id, count(m.pos) AS total_docs_retrieved,
        coalesce(max(m.chunk_index), 0) AS num_chunks, 5 AS chunk_size
        FROM documents d LEFT JOIN chunked m ON m.query_id = d.doc_id GROUP BY d.doc_id""",
    "chunk_prompts": _SQL_BASE + f", {_SQL_PROMPTS}" + f""" SELECT query_id, chunk_index, sha256(prompt) AS prompt_hash,
        length(prompt)::INT AS n_chars, sha256(prompt || '|' || {quoted(K.ANSWER_SYSTEM)} || '|default|[]') AS cache_key FROM prompts""",
    "recommend": _SQL_RECOMMEND,
    "run_events": _SQL_EVENTS,
    "token_stream": _SQL_RUN + """,
        w AS (SELECT query_id, chunk_index, CASE WHEN right(sha256(prompt), 1) = '0'
              THEN ['[Error generating response for chunk ' || chunk_index || ']']
              ELSE list_transform(range(0, 9), lambda i: substr('answer ' || sha256(prompt), 1 + i * 8, 8)) END AS t FROM prompts)
        SELECT query_id, chunk_index, i AS token_no, t[i] AS token
        FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM w)""",
    "streamed_events": _SQL_RUN + """
        SELECT query_id, chunk_index, n AS num_docs_in_chunk, n AS n_docs, CASE WHEN right(sha256(prompt), 1) = '0'
            THEN '[Error generating response for chunk ' || chunk_index || ']' ELSE 'answer ' || sha256(prompt) END AS generated_response,
        'success' AS status, false AS streaming FROM prompts""",
    "confidence_parts": _SQL_CONFIDENCE,
    "faithfulness": _SQL_CLAIMS + """ SELECT query_id, chunk_index, total_claims, supported_claims,
        round(score, 6) AS faithfulness_score FROM scores""",
    "faithfulness_per_query": _SQL_CLAIMS + """ SELECT query_id, round(avg(score), 6) AS aggregate_faithfulness,
        count(*) AS num_chunks FROM scores GROUP BY query_id""",
}

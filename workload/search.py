"""Search, filters, reranking and collection queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from sparkrec.config import Params
from sparkrec.functions.scores import dense_score
from sparkrec.operators import counts, ivf
from sparkrec.operators.filters import knn_category_gate, knn_filtered, where_to_column
from sparkrec.operators.knn import knn_topk
from sparkrec.operators.models import embed_texts
from sparkrec.operators.rerank import apply_results
from sparkrec.plans.retrieve import retrieve
from sparkrec.sources import collection as coll
from sparkrec.storage import cut_lineage, scratch_path
from workload.base import (
    SQL_INPUTS, collection, questions, sql_hits, stand_in_rerank, stand_in_scores, stand_in_vectors,
    table, variants,
)

_SQL_HIT = "query_id, variant_no, rank, doc_id, round(distance, 6) AS distance"


def _hits(df):
    return df.select("query_id", "variant_no", "rank", "doc_id", F.round("distance", 6).alias("distance"))


def knn_l2(spark, sf):
    hits = knn_topk(variants(spark, sf), collection(spark, sf), 20)
    return hits.select("query_id", "variant_no", "rank", "doc_id",
                       F.round("distance", 6).alias("distance"),
                       F.round(dense_score(F.col("distance")), 6).alias("dense_score"))


def knn_cosine(spark, sf):
    return _hits(knn_topk(variants(spark, sf), collection(spark, sf), 20, "cosine"))


def knn_ip(spark, sf):
    return _hits(knn_topk(variants(spark, sf), collection(spark, sf), 20, "ip"))


def knn_seeded(spark, sf):
    """The bound from one language's documents leaves the result as it is."""
    docs = collection(spark, sf)
    return _hits(knn_topk(variants(spark, sf), docs, 20, seeds=docs.where("lang = 'de'"), tasks=4))


_FILTERS = {
    "german": {"lang": "de"},
    "two_sources": {"$or": [{"source": "src1"}, {"source": {"$in": ["src2", "src3"]}}]},
    "high_label": {"label": {"$gte": 5}, "lang": {"$ne": "en"}},
    "nothing": {"lang": "xx"},
}


def filtered(spark, sf):
    docs = collection(spark, sf)
    promoted = {"lang": F.col("lang"), "source": F.col("source")}
    filters = {name: where_to_column(w, promoted) for name, w in _FILTERS.items()}
    names = F.array(*[F.lit(n) for n in _FILTERS])
    asked = variants(spark, sf).withColumn(
        "filter_name", F.get(names, (F.col("query_id") % 5).cast("int")))  # the fifth has none
    return _hits(knn_filtered(asked, docs, 5, filters))


_SQL_FILTERED = f"""
WITH {SQL_INPUTS},
f AS (SELECT 'german' AS name, doc_id FROM c WHERE lang = 'de'
      UNION ALL SELECT 'two_sources', doc_id FROM c WHERE source IN ('src1', 'src2', 'src3')
      UNION ALL SELECT 'high_label', doc_id FROM c WHERE label >= 5 AND lang <> 'en'),
asked AS (SELECT q.*, CASE query_id % 5 WHEN 0 THEN 'german' WHEN 1 THEN 'two_sources'
          WHEN 2 THEN 'high_label' WHEN 3 THEN 'nothing' END AS filter_name FROM q),
qf AS (SELECT asked.*, filter_name IN (SELECT name FROM f) AS usable FROM asked),
{sql_hits(5, "NOT coalesce(qf.usable, false) OR (qf.filter_name, c.doc_id) IN (SELECT (name, doc_id) FROM f)", variants="qf")}
SELECT {_SQL_HIT} FROM hits"""


def category_gate(spark, sf):
    return _hits(knn_category_gate(_gated(spark, sf), collection(spark, sf), 5))


_SQL_GATE = f"""
WITH {SQL_INPUTS},
g AS (SELECT q.*, CASE WHEN variant_no = 1 THEN NULL WHEN query_id % 4 = 0 THEN ['de', 'fr']
      WHEN query_id % 4 = 1 THEN ['zz'] WHEN query_id % 4 = 2 THEN ['es', 'zz'] END AS wanted FROM q),
gq AS (SELECT g.*, list_has_any(wanted, (SELECT list(DISTINCT lang) FROM c)) AS usable FROM g),
{sql_hits(5, "NOT coalesce(gq.usable, false) OR list_contains(gq.wanted, c.lang)", variants="gq")}
SELECT {_SQL_HIT} FROM hits"""


def approximate_all_cells(spark, sf):
    """With every cell probed the approximate search is exact."""
    docs = collection(spark, sf)
    centres = ivf.train_cells(docs, 8)
    return _hits(ivf.knn_approximate(variants(spark, sf), docs, 10, centres, 8))


CELLS = 256  # at most, however large the tables are; documents of all sizes are placed in them


def approximate_recall(spark, sf):
    """What three cells of each variant find of the exact result."""
    docs, asked = collection(spark, sf), variants(spark, sf)
    found = ivf.knn_approximate(asked, docs, 10, _centres(spark, sf), 3)
    per_query = ivf.recall(found, knn_topk(asked, docs, 10))
    return per_query.select("query_id", "variant_no", F.round("recall", 6).alias("recall"))


def _centres(spark, sf):
    """The centres of the cells: the vectors of the CELLS smallest ids divisible by 50."""
    rows = table(spark, sf, "embeddings").where("vec_id % 50 = 0").orderBy("vec_id").limit(CELLS)
    return rows.select("embedding").toPandas()["embedding"].tolist()


def _stored_cells(spark, sf, centres):
    path = scratch_path(spark, "cells")
    with_cells = ivf.assign_cells(collection(spark, sf), centres)
    coll.as_collection(with_cells, "papers").sortWithinPartitions("cell").write.partitionBy("collection").parquet(path)
    return coll.open_collection(spark, path, "papers")


def approximate_stored(spark, sf):
    """A collection stored with cells; three cells are read for each variant."""
    centres = _centres(spark, sf)
    return _hits(ivf.knn_approximate(variants(spark, sf), _stored_cells(spark, sf, centres), 10, centres, 3))


def exact_by_cells(spark, sf):
    """Three cells bound each variant; further ones are read only where they could help."""
    centres = _centres(spark, sf)
    docs = _stored_cells(spark, sf, centres)
    return _hits(ivf.knn_by_cells(variants(spark, sf), docs, 10, ivf.measure_cells(docs, centres), 3))


def _half_broken(texts):
    """Vectors, but for texts with an odd number of letters: these fail."""
    return [None if len(t) % 2 else v for t, v in zip(texts, stand_in_vectors(texts))]


def index_repair(spark, sf):
    """An index in three appends, one of which is repeated and one fails once rows are
    written; then what has no vector is embedded again."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("document"), F.create_map(F.lit("categories"), F.col("lang")).alias("meta"))
    path = scratch_path(spark, "index")
    for part in (0, 1, 1):
        coll.build_index(docs.where(F.col("doc_id") % 3 == part), path, _half_broken, "papers", append_id=f"part-{part}")
    lost = coll.as_collection(docs.where("doc_id % 3 = 2"), "papers").drop("collection")
    lost.write.parquet(f"{path}/collection=papers/append=lost")  # never committed
    coll.build_index(docs, path, stand_in_vectors, "papers")
    before = coll.open_collection(spark, path, "papers").select("doc_id", F.col("embedding").isNull().alias("was_missing"))
    after = coll.repair_index(spark, path, stand_in_vectors, "papers")
    return after.join(before, "doc_id").select("doc_id", "category", "text_hash", "was_missing", F.col("embedding").isNotNull().alias("has_vector"))


def two_collections(spark, sf):
    """Two names in one folder; each is opened, switched to and scanned by itself."""
    docs = table(spark, sf, "documents").select(
        "doc_id", "source", F.col("text").alias("document"), F.create_map(F.lit("categories"), F.col("lang")).alias("meta"))
    path = scratch_path(spark, "two")
    odd = F.col("doc_id") % 2 == 1
    coll.build_index(docs.where(odd).drop("source"), path, stand_in_vectors, "odd")
    coll.build_index(docs.where(~odd).drop("source"), path, stand_in_vectors, "even")
    rows = [coll.scan(coll.open_collection(spark, path, n)).select(
        F.lit(n).alias("name"), "doc_id", F.length("document").alias("n_chars"), F.col("meta")["categories"].alias("category"))
        for n in ("even", "odd", "absent")]
    return rows[0].union(rows[1]).union(rows[2])


def _gated(spark, sf):
    """Variants with categories; some name none that exists, some are not sure."""
    return variants(spark, sf).withColumns({
        "categories": F.when(F.col("query_id") % 4 == 0, F.array(F.lit("de"), F.lit("fr")))
        .when(F.col("query_id") % 4 == 1, F.array(F.lit("zz")))
        .when(F.col("query_id") % 4 == 2, F.array(F.lit("es"), F.lit("zz")))
        .otherwise(F.array().cast("array<string>")),
        "confidence": F.when(F.col("variant_no") == 1, "medium").otherwise("high"),
    })


def gate_approximate(spark, sf):
    """Category gate and cells at once, through `retrieve`."""
    docs, centres = collection(spark, sf), _centres(spark, sf)
    return _hits(retrieve(_gated(spark, sf), ivf.assign_cells(docs, centres), category_gate=True, centres=centres, probes=3))


_SQL_CELLS = f"""
cs AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cell, embedding::DOUBLE[] AS cv FROM embeddings WHERE vec_id % 50 = 0
       QUALIFY cell < {CELLS}),
near AS (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(embedding::DOUBLE[], cv), cell) AS n
         FROM embeddings, cs),
placed AS (SELECT vec_id, cell FROM near WHERE n = 1), looks AS (SELECT vec_id, list(cell) AS cells FROM near WHERE n <= 3 GROUP BY vec_id)"""



def get_documents(spark, sf):
    where = {"$or": [{"source": "src7"}, {"$and": [{"lang": "es"}, {"label": {"$lt": 3}}]}]}
    found = coll.get_documents(collection(spark, sf), where,
                               {"lang": F.col("lang"), "source": F.col("source")})
    return found.select("doc_id", "document")


def collection_counts(spark, sf):
    docs = collection(spark, sf).withColumn("collection", F.col("source"))
    per = counts.collection_counts(docs)
    return per.select("collection", "n_docs", counts.candidate_budget(5, 4, F.col("n_docs")).alias("budget"))


def filtered_counts(spark, sf):
    docs = collection(spark, sf)
    return counts.filtered_count(docs, where_to_column({"lang": {"$in": ["de", "fr"]}, "label": {"$gt": 2}},
                                                       {"lang": F.col("lang")}))


def embedding_check(spark, sf):
    docs = table(spark, sf, "documents")
    vectors = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return counts.embedding_check(docs.join(vectors, "doc_id", "left"), 64, "lang")


def embedded_texts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("document"))
    out = embed_texts(docs, stand_in_vectors)
    return out.select("doc_id", F.size("embedding").alias("dim"),
                      F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4)
                      .alias("total"))


_HEX = " + ".join(f"('0x' || substr(h, {i}, 4))::INT / 65535.0" for i in range(1, 33, 4))


def index_build(spark, sf):
    """Two runs over one folder: the second, over all documents, adds the rest only."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("document"), "lang",
        F.create_map(F.lit("categories"), F.col("lang")).alias("meta"))
    path = scratch_path(spark, "index")
    coll.build_index(docs.where("lang <> 'fr'").drop("lang"), path, stand_in_vectors, "papers")
    built = coll.build_index(docs.drop("lang"), path, stand_in_vectors, "papers")
    return built.groupBy("collection", "category").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_distinct("doc_id").alias("n_ids"),
        F.count("embedding").alias("n_vectors"), F.count_distinct("text_hash").alias("n_texts"))


def rerank_join(spark, sf):
    """Service results made from the candidates' labels: some indexes lie outside the
    list, and the calls of some queries failed."""
    docs = collection(spark, sf)
    hits = cut_lineage(knn_topk(variants(spark, sf), docs, 20, carry=["label"]), "hits")  # read four times below
    w = W.partitionBy("query_id", "variant_no").orderBy(F.desc("label"), F.desc("doc_id"))
    failed = F.col("query_id") % 4 == 0
    results = hits.select(
        "query_id", "variant_no", F.row_number().over(w).alias("result_no"),
        F.when(F.col("label") == 9, F.col("rank") + 99).otherwise(F.col("rank") - 1).alias("index"),
        (F.col("label") / 10).alias("relevance_score"), F.when(failed, "timeout").alias("error"))
    out = apply_results(hits.drop("label"), results, 8, 5)
    return out.select("query_id", "variant_no", "rank", "dense_rank", "doc_id",
                      F.round("rerank_score", 6).alias("rerank_score"))


_SQL_RERANK = f"""
WITH {SQL_INPUTS}, {sql_hits(20)},
res AS (SELECT query_id, variant_no, rank, doc_id, label, query_id % 4 = 0 AS failed,
        row_number() OVER (PARTITION BY query_id, variant_no ORDER BY label = 9, label DESC, doc_id DESC) AS n FROM hits)
SELECT query_id, variant_no, CASE WHEN failed THEN rank ELSE n::INT END AS rank, rank AS dense_rank, doc_id,
       CASE WHEN NOT failed THEN round(label / 10.0, 6)::DOUBLE END AS rerank_score
FROM res WHERE CASE WHEN failed THEN rank <= 5 ELSE n <= 8 AND label <> 9 END"""


def _asked_with_text(spark, sf):
    return variants(spark, sf).join(questions(spark, sf), "query_id")


def rerank_scored(spark, sf):
    hits = retrieve(_asked_with_text(spark, sf), collection(spark, sf), Params(top_k=5), scorer=stand_in_scores)
    return hits.select("query_id", "variant_no", "rank", "dense_rank", "doc_id",
                       F.round("cross_score", 6).alias("cross_score"))


def rerank_called(spark, sf):
    hits = retrieve(_asked_with_text(spark, sf), collection(spark, sf), Params(top_k=5, rerank_top_n=7),
                    reranker=stand_in_rerank)
    return hits.select("query_id", "variant_no", "rank", "dense_rank", "doc_id",
                       F.round("rerank_score", 6).alias("rerank_score"))


def rerank_fallback(spark, sf):
    """Variants whose rerank call fails are ordered by the pair scorer."""
    hits = retrieve(_asked_with_text(spark, sf), collection(spark, sf), Params(top_k=5, rerank_top_n=7),
                    reranker=stand_in_rerank, scorer=stand_in_scores)
    return hits.select("query_id", "variant_no", "rank", "dense_rank", "doc_id",
                       F.round("rerank_score", 6).alias("rerank_score"), F.round("cross_score", 6).alias("cross_score"))


_SQL_SCORED = f"""
WITH {SQL_INPUTS}, {sql_hits(20)},
s AS (SELECT hits.*, ((length(d.text) * 7 + length(document)) % 101)::DOUBLE AS score, length(d.text) % 10 = 0 AS failed
      FROM hits JOIN documents d ON d.doc_id = hits.query_id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY score DESC, rank)::INT AS n FROM s)"""


def where_search(spark, sf):
    hits = retrieve(variants(spark, sf), collection(spark, sf), where={"label": {"$nin": [1, 2]}, "lang": "fr"},
                    columns={"lang": F.col("lang")})
    return _hits(hits)


QUERIES = {
    "knn_topk": knn_l2,
    "knn_topk_cosine": knn_cosine,
    "knn_topk_ip": knn_ip,
    "knn_seeded": knn_seeded,
    "knn_filtered": filtered,
    "knn_category_gate": category_gate,
    "knn_where": where_search,
    "knn_approximate_all_cells": approximate_all_cells,
    "knn_approximate_recall": approximate_recall,
    "get_documents": get_documents,
    "collection_counts": collection_counts,
    "filtered_counts": filtered_counts,
    "embedding_check": embedding_check,
    "embed_texts": embedded_texts,
    "index_build": index_build,
    "rerank_join": rerank_join,
    "rerank_scored": rerank_scored,
    "rerank_called": rerank_called,
    "rerank_fallback": rerank_fallback,
    "knn_approximate_stored": approximate_stored,
    "knn_by_cells": exact_by_cells,
    "index_repair": index_repair,
    "two_collections": two_collections,
    "gate_approximate": gate_approximate,
}

ORACLE = {
    "knn_topk": f"WITH {SQL_INPUTS}, {sql_hits(20)} SELECT {_SQL_HIT}, round(1 / (1 + distance), 6) AS dense_score FROM hits",
    "knn_topk_cosine": f"WITH {SQL_INPUTS}, {sql_hits(20, metric='cosine')} SELECT {_SQL_HIT} FROM hits",
    "knn_topk_ip": f"WITH {SQL_INPUTS}, {sql_hits(20, metric='ip')} SELECT {_SQL_HIT} FROM hits",
    "knn_seeded": f"WITH {SQL_INPUTS}, {sql_hits(20)} SELECT {_SQL_HIT} FROM hits",
    "knn_filtered": _SQL_FILTERED,
    "knn_category_gate": _SQL_GATE,
    "knn_where": f"WITH {SQL_INPUTS}, {sql_hits(5, 'c.lang = $$fr$$ AND c.label NOT IN (1, 2)')} SELECT {_SQL_HIT} FROM hits",
    "knn_approximate_all_cells": f"WITH {SQL_INPUTS}, {sql_hits(10)} SELECT {_SQL_HIT} FROM hits",
    "get_documents": f"WITH {SQL_INPUTS} SELECT doc_id, document FROM c WHERE source = 'src7' OR (lang = 'es' AND label < 3)",
    "collection_counts": f"""WITH {SQL_INPUTS} SELECT source AS collection, count(*) AS n_docs,
        least(20, count(*)) AS budget FROM c GROUP BY source""",
    "filtered_counts": f"""WITH {SQL_INPUTS} SELECT count(*) FILTER (WHERE lang IN ('de', 'fr') AND label > 2) AS n_match,
        count(*) AS n_docs FROM c""",
    "embedding_check": """SELECT lang, count(*) AS n_expected, count(embedding) AS n_received,
        count(*) FILTER (WHERE len(embedding) <> 64) AS n_wrong_size
        FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id GROUP BY lang""",
    "embed_texts": f"""SELECT doc_id, 8 AS dim, round({_HEX}, 4)::DOUBLE AS total
        FROM (SELECT doc_id, sha256(replace(text, chr(10), ' ')) AS h FROM documents)""",
    "index_build": """SELECT 'papers' AS collection, lang AS category, count(*) AS n_docs, count(DISTINCT doc_id) AS n_ids,
        count(*) AS n_vectors, count(DISTINCT text) AS n_texts FROM documents GROUP BY lang""",
    "rerank_join": _SQL_RERANK,
    "rerank_scored": _SQL_SCORED + """
        SELECT query_id, variant_no, n AS rank, rank AS dense_rank, doc_id, score AS cross_score FROM o WHERE n <= 5""",
    "rerank_called": _SQL_SCORED + """
        SELECT query_id, variant_no, n AS rank, rank AS dense_rank, doc_id, score AS rerank_score FROM o WHERE n <= 7 AND NOT failed
        UNION ALL SELECT query_id, variant_no, rank, rank, doc_id, NULL FROM o WHERE failed AND rank <= 5""",
    "rerank_fallback": _SQL_SCORED + """
        SELECT query_id, variant_no, n AS rank, rank AS dense_rank, doc_id, CASE WHEN NOT failed THEN score END AS rerank_score,
               CASE WHEN failed THEN score END AS cross_score FROM o WHERE n <= CASE WHEN failed THEN 5 ELSE 7 END""",
    "knn_by_cells": f"WITH {SQL_INPUTS}, {sql_hits(10)} SELECT {_SQL_HIT} FROM hits",
    "index_repair": """SELECT doc_id, lang AS category, sha256(text) AS text_hash,
        doc_id % 3 < 2 AND length(replace(text, chr(10), ' ')) % 2 = 1 AS was_missing, true AS has_vector FROM documents""",
    "two_collections": """SELECT CASE WHEN doc_id % 2 = 1 THEN 'odd' ELSE 'even' END AS name, doc_id,
        length(text)::INT AS n_chars, lang AS category FROM documents""",
    "knn_approximate_recall": f"""WITH {SQL_INPUTS}, {_SQL_CELLS},
        pairs AS (SELECT query_id, variant_no, doc_id, pow(list_distance(qv, dv), 2) AS distance, list_contains(cells, placed.cell) AS near
          FROM q JOIN looks ON looks.vec_id = query_id * 5 + variant_no JOIN c ON dv IS NOT NULL JOIN placed ON placed.vec_id = doc_id),
        best AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY distance, doc_id) AS rank FROM pairs QUALIFY rank <= 10)
        SELECT query_id, variant_no, round(count(*) FILTER (near) / count(*), 6)::DOUBLE AS recall FROM best GROUP BY query_id, variant_no""",
    "knn_approximate_stored": f"""WITH {SQL_INPUTS}, {_SQL_CELLS},
        pairs AS (SELECT query_id, variant_no, doc_id, pow(list_distance(qv, dv), 2) AS distance
          FROM q JOIN looks ON looks.vec_id = query_id * 5 + variant_no JOIN c ON dv IS NOT NULL JOIN placed ON placed.vec_id = doc_id
          WHERE list_contains(cells, placed.cell)),
        hits AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY distance, doc_id)::INT AS rank FROM pairs)
        SELECT {_SQL_HIT} FROM hits WHERE rank <= 10""",
    "gate_approximate": _SQL_GATE.split("pairs AS")[0].replace(f"WITH {SQL_INPUTS}", f"WITH {SQL_INPUTS}, {_SQL_CELLS}") + f"""
        pairs AS (SELECT query_id, variant_no, doc_id, pow(list_distance(qv, dv), 2) AS distance
          FROM gq JOIN looks ON looks.vec_id = query_id * 5 + variant_no JOIN c ON dv IS NOT NULL JOIN placed ON placed.vec_id = doc_id
          WHERE list_contains(cells, placed.cell) AND (NOT coalesce(gq.usable, false) OR list_contains(gq.wanted, c.lang))),
        hits AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY distance, doc_id)::INT AS rank FROM pairs)
        SELECT {_SQL_HIT} FROM hits WHERE rank <= 5""",
}

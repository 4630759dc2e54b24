"""Retrieval for a table of query variants."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from sparkrec.config import DEFAULTS, Params
from sparkrec.functions.scores import dense_score
from sparkrec.operators import bloom
from sparkrec.operators.filters import knn_category_gate, knn_filtered, where_to_column
from sparkrec.operators.ivf import knn_approximate
from sparkrec.operators.knn import knn_topk
from sparkrec.operators.models import embed_texts, score_pairs
from sparkrec.operators.rerank import apply_results, call_reranker, cut_by_score
from sparkrec.storage import cut_lineage


def among(rows: DataFrame, id_col: str, kept: DataFrame) -> DataFrame:
    """`rows` less most of those whose `id_col` is not in the stored table `kept`: a Bloom
    filter drops them where they are read, up to 44 million different ids."""
    own = F.col(id_col).cast("long")
    ids = cut_lineage(kept.select(own.alias(id_col)).distinct(), "ids")
    bits = bloom.bits_for(ids.count())
    return rows.where(bloom.might_contain(bloom.build(ids, id_col, bits), own, bits)) if bits else rows


def attach_documents(hits: DataFrame, collection: DataFrame, columns: tuple[str, ...] = ("document", "meta"),
                     kept: bool = False) -> DataFrame:
    """Texts of hits. Documents that are no hits are dropped where they are read.

    A Bloom filter of the hits' ids lets under 1 % of the others through. It has 12 bits
    for each document that is a hit, and goes to the scan up to 64 MB, or 44 million such
    documents; beyond that the join shuffles the texts of the collection. `kept` says that
    `hits` is stored; else it is stored here, since it is read twice.
    """
    hits = hits if kept else cut_lineage(hits, "hits")
    return hits.join(among(collection.select("doc_id", *columns), "doc_id", hits), "doc_id")


def with_vectors(variants: DataFrame, embed: Callable | None, params: Params = DEFAULTS,
                 setup: Callable | None = None) -> DataFrame:
    """Variants with vectors. The model runs once per variant, so its output is kept."""
    if "embedding" in variants.columns:
        return variants
    return cut_lineage(embed_texts(variants, embed, text="text", batch=params.embedding_batch, setup=setup))


def retrieve(
    variants: DataFrame,
    collection: DataFrame,
    params: Params = DEFAULTS,
    *,
    embed: Callable | None = None,
    where: Mapping | None = None,
    columns: Mapping[str, Column] | None = None,
    category_gate: bool = False,
    reranker: Callable | None = None,
    scorer: Callable | None = None,
    centres: np.ndarray | None = None,
    probes: int = 8,
    filters: Mapping[str, Column] | None = None,
    seeds: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Ranked hits (query_id, variant_no, rank, doc_id, distance, dense_score, text_hash).

    The candidate budget is fetched only when a reranker or scorer will cut it;
    otherwise the first top_k are asked for right away, with the same result.
    A filter without any match is dropped. The category gate needs `categories`
    and `confidence` columns on the variants. `filters` are named; a variant's
    filter_name column says which is its own. With `centres` the search is
    approximate: it looks into the `probes` nearest cells of each variant, and only
    into those documents there that a filter or gate lets through. `seeds` and
    `tasks` are handed to the search. A variant whose rerank call fails is ordered
    by the scorer if there is one, else by distance.
    """
    variants = with_vectors(variants, embed, params)
    n = params.budget if reranker or scorer else params.top_k
    hashed = "text_hash" in collection.columns
    search: dict = dict(metric=params.metric, carry=["text_hash"] if hashed else [], tasks=tasks)
    if seeds is not None:
        search["seeds"] = seeds
    if where:
        matching = collection.where(where_to_column(where, columns))
        if not matching.select("doc_id").isEmpty():  # stops at the first match
            collection = matching
    if filters and category_gate:
        raise ValueError("named filters and the category gate cannot be combined")
    if centres is not None:
        search |= dict(search=knn_approximate, centres=centres, probes=probes)
        if seeds is not None:
            raise ValueError("seeds bound the exact search only")
    if category_gate:
        hits = knn_category_gate(variants, collection, n, **search)
    elif filters:
        hits = knn_filtered(variants, collection, n, filters, **search)
    else:
        hits = search.pop("search", knn_topk)(variants, collection, n, **search)
    if not hashed:  # of the hits' texts only, each once; the texts stay where they are
        hits = cut_lineage(hits, "hits")
        hits = attach_documents(hits, collection.withColumn("text_hash", F.sha2("document", 256)), ("text_hash",), kept=True)
    hits = hits.withColumn("dense_score", dense_score(F.col("distance")))
    if not (reranker or scorer):
        return hits
    hits = cut_lineage(hits, "hits")  # read twice below; the search runs once
    asked = attach_documents(hits, collection, ("document",), kept=True).join(
        variants.select("query_id", "variant_no", "text"), ["query_id", "variant_no"])

    def by_score(rows: DataFrame) -> DataFrame:
        return cut_by_score(score_pairs(rows, scorer).drop("document", "text"), params.top_k)

    if not reranker:
        return by_score(asked)
    results = cut_lineage(call_reranker(asked, reranker, params.rerank_cut), "reranked")
    if not scorer:
        return apply_results(hits, results, params.rerank_cut, params.top_k)
    keys = ["query_id", "variant_no"]
    failed = results.where("error IS NOT NULL").select(*keys).distinct()
    served = apply_results(hits, results.where("error IS NULL"), params.rerank_cut, params.top_k)
    return served.unionByName(by_score(asked.join(failed, keys, "left_semi")), allowMissingColumns=True)

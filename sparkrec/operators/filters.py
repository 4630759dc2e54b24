"""Metadata filters, the fallback for filters without a match, the category gate."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sparkrec.functions.text import strip_client
from sparkrec.operators.knn import knn_topk
from sparkrec import constants as K


# --- where documents --------------------------------------------------------------

def _typed(c: Column, value) -> tuple[Column, Column]:
    """Metadata values are text; a number or boolean says how to read them."""
    if isinstance(value, bool):
        return F.lower(c), F.lit(str(value).lower())
    if isinstance(value, (int, float)):
        return c.try_cast("double"), F.lit(float(value))
    return c, F.lit(value)


def _compare(c: Column, op: str, value, own_column: bool) -> Column:
    if op in ("$ne", "$nin"):
        # A missing key is different from every value.
        same = _compare(c, "$eq" if op == "$ne" else "$in", value, own_column)
        return ~F.coalesce(same, F.lit(False))
    if op == "$in":
        if own_column:
            return c.isin(list(value))
        return functools.reduce(operator.or_, [_compare(c, "$eq", v, False) for v in value], F.lit(False))
    left, right = (c, F.lit(value)) if own_column else _typed(c, value)
    tests = {"$eq": operator.eq, "$gt": operator.gt, "$gte": operator.ge,
             "$lt": operator.lt, "$lte": operator.le}
    return tests[op](left, right)


def where_to_column(where: Mapping | None, columns: Mapping[str, Column] | None = None,
                    meta: str = "meta") -> Column:
    """A filter document as a predicate.

    `columns` names keys kept as columns of their own; filters on those reach the
    Parquet scan. Other keys are looked up in the metadata map.
    """
    columns = columns or {}
    parts: list[Column] = []
    for key, value in (where or {}).items():
        if key in ("$and", "$or"):
            inner = [where_to_column(w, columns, meta) for w in value]
            if not inner:
                raise ValueError(f"{key} needs at least one condition")
            parts.append(functools.reduce(operator.and_ if key == "$and" else operator.or_, inner))
            continue
        c = columns[key] if key in columns else F.col(meta)[key]
        conditions = value if isinstance(value, Mapping) else {"$eq": value}
        parts += [_compare(c, op, v, key in columns) for op, v in conditions.items()]
    return functools.reduce(operator.and_, parts, F.lit(True))


# --- prompts ------------------------------------------------------------------------

def split_prompts(prompts: DataFrame, text: str = "text", strict: bool = False
                  ) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected prompts. Strict also rejects blank ones, as the client does."""
    c = strip_client(F.col(text)) if strict else F.col(text)
    ok = F.coalesce(F.length(c) > 0, F.lit(False))
    return prompts.where(ok), prompts.where(~ok).withColumn("error", F.lit(K.MSG_PROMPT_REQUIRED))


# --- filtered search -------------------------------------------------------------------

def match_counts(docs: DataFrame, filters: Mapping[str, Column]) -> DataFrame:
    """(filter_name, n_match) of all filters in one pass; no text is read."""
    pairs = [F.struct(F.lit(name).alias("filter_name"), F.count_if(cond).alias("n_match"))
             for name, cond in filters.items()]
    return docs.agg(F.array(*pairs).alias("m")).select(F.inline("m"))


def knn_filtered(queries: DataFrame, docs: DataFrame, n: int, filters: Mapping[str, Column],
                 filter_col: str = "filter_name", search: Callable = knn_topk, **knn) -> DataFrame:
    """Search where each query names one of a fixed set of filters (null: none).

    A filter without any match is dropped for its queries; one pass over the
    documents serves all filters.
    """
    counts = F.broadcast(match_counts(docs, filters))  # one row per filter
    usable = F.col("n_match") > 0
    gated = queries.join(counts, queries[filter_col] == counts["filter_name"], "left").select(
        *[queries[c] for c in queries.columns],
        F.when(usable, F.array(queries[filter_col])).alias("_allowed"),
    )
    marks = F.array(*[F.when(cond, F.lit(name)) for name, cond in filters.items()])
    marked = docs.withColumn("_marks", F.array_compact(marks))
    return search(gated, marked, n, allowed="_allowed", labels="_marks", **knn)


def category_labels(category: Column) -> Column:
    """Codes of a document; several are separated by blanks."""
    return F.filter(F.split(category, r"\s+"), lambda x: F.length(x) > 0)


def gate_by_category(queries: DataFrame, docs: DataFrame,
                     keys: Sequence[str] = ("query_id", "variant_no"),
                     category: str = "category") -> DataFrame:
    """Add `allowed`: the query's categories when confidence is high and some
    document has one of them, else null (no restriction)."""
    wanted = F.when((F.col("confidence") == "high") & (F.size("categories") > 0), F.col("categories"))
    queries = queries.withColumn("allowed", F.array_distinct(wanted))
    present = (docs.select(F.explode(category_labels(F.col(category))).alias("_code"))
               .groupBy("_code").count().select("_code"))
    matched = (queries.where(F.col("allowed").isNotNull())
               .select(*keys, F.explode("allowed").alias("_code"))
               .join(present, "_code", "left_semi")
               .select(*keys).distinct().withColumn("_found", F.lit(True)))
    return (queries.join(matched, list(keys), "left")
            .withColumn("allowed", F.when(F.col("_found"), F.col("allowed")))
            .drop("_found"))


def knn_category_gate(queries: DataFrame, docs: DataFrame, n: int,
                      keys: Sequence[str] = ("query_id", "variant_no"),
                      category: str = "category", search: Callable = knn_topk, **knn) -> DataFrame:
    """Search gated by category; `search` may be the approximate one."""
    gated = gate_by_category(queries, docs, keys, category)
    labelled = docs.withColumn("_labels_of", category_labels(F.col(category)))
    return search(gated, labelled, n, keys=keys, allowed="allowed", labels="_labels_of", **knn)

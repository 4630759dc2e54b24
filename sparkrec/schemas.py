"""Declared schemas; nothing in the package infers one."""

from pyspark.sql import types as T

DOC = T.StructType([
    T.StructField("document", T.StringType()),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
])

RESEARCH = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("authors", T.StringType()),
])
RESEARCH_LENGTHS = {"title": 255, "category": 100, "authors": 255}

PROMPT = T.StructType([T.StructField("input_prompt", T.StringType())])

# text_hash identifies a text in shuffles, so the text itself stays out of them.
COLLECTION = T.StructType([
    T.StructField("collection", T.StringType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("document", T.StringType()),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    T.StructField("category", T.StringType()),
    T.StructField("text_hash", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("cell", T.IntegerType()),
    T.StructField("cells", T.StringType()),  # which centres the cell is one of
])

# One wide row per event; fields a type does not use are null, and so left out
# of its JSON.
EVENT_PAYLOAD = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("step", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("num_docs_in_chunk", T.IntegerType()),
    T.StructField("token", T.StringType()),
    T.StructField("docs", T.ArrayType(DOC)),
    T.StructField("generated_response", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("total_docs_retrieved", T.LongType()),
    T.StructField("num_chunks", T.IntegerType()),
    T.StructField("chunk_size", T.IntegerType()),
    T.StructField("elapsed_ms", T.LongType()),
])
EVENT_KEYS = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
])
EVENTS = T.StructType(EVENT_KEYS.fields + EVENT_PAYLOAD.fields)

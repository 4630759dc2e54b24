"""User-supplied model functions over columns and rows.

Only the columns a function needs are sent to Python. A failing call yields a
null or an error text in its own rows and never shifts or loses others. The functions
count as nondeterministic, so that no plan calls one twice for a row. With `setup`, the
function is built once per task (to load a model there).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sparkrec import constants as K
from sparkrec.config import DEFAULTS
from sparkrec.functions.text import clean_newlines

TOKENS = 4096  # that leave a task together, or one answer's

GENERATED = T.StructType([
    T.StructField("response", T.StringType()),
    T.StructField("error", T.StringType()),
])


def embed_texts(df: DataFrame, fn: Callable | None = None, *, text: str = "document",
                out: str = "embedding", batch: int = DEFAULTS.embedding_batch,
                setup: Callable | None = None) -> DataFrame:
    """Add vectors from `fn(list of texts) -> list of vectors`, called per batch. Texts stay in
    Arrow until their batch is called, so a worker holds one batch of strings at a time."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        call, kind = setup() if setup else fn, pa.list_(pa.float32())
        for texts in columns:
            vectors = [pa.array([], kind)]
            for start in range(0, len(texts), batch):
                part = texts.slice(start, batch).to_pylist()
                try:
                    got = list(call(part))
                    if len(got) != len(part):
                        raise ValueError(f"{len(part)} texts gave {len(got)} vectors")
                except Exception:
                    got = [None] * len(part)
                vectors.append(pa.array([None if v is None else np.asarray(v, np.float32) for v in got], kind))
            yield pa.concat_arrays(vectors)

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    embed = F.arrow_udf(run, T.ArrayType(T.FloatType())).asNondeterministic()
    return df.withColumn(out, embed(clean_newlines(F.coalesce(F.col(text), F.lit("")))))


def generate(requests: DataFrame, fn: Callable | None = None, *, retries: int = 2,
             setup: Callable | None = None) -> DataFrame:
    """Add response and error from `fn(system, prompt, model) -> text`."""

    def run(columns: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = setup() if setup else fn
        for frame in columns:
            rows = []
            for system, prompt, model in zip(frame["system"], frame["prompt"], frame["model"]):
                response, error = None, None
                for _ in range(retries + 1):
                    try:
                        response, error = call(system, prompt, model), None
                        response = "" if response is None else str(response)
                        break
                    except Exception as exc:
                        error = f"{type(exc).__name__}: {exc}"
                rows.append((response, error))
            yield pd.DataFrame(rows, columns=["response", "error"], dtype=object)

    run.__annotations__ = {"columns": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(run, GENERATED).asNondeterministic()
    done = requests.withColumn("_g", udf(F.struct("system", "prompt", "model")))
    return done.withColumns({"response": F.col("_g.response"), "error": F.col("_g.error")}).drop("_g")


def stream_tokens(requests: DataFrame, fn: Callable | None = None, *, retries: int = 2,
                  setup: Callable | None = None) -> DataFrame:
    """Rows (query_id, chunk_index, token_no, token) of `fn(system, prompt, model)`,
    which yields tokens. A call that fails for good before its first token gives
    the error text of its chunk; tokens already out stay out."""
    schema = "query_id long, chunk_index int, token_no long, token string"
    error_text, names = K.CHUNK_ERROR, ["query_id", "chunk_index", "token_no", "token"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = setup() if setup else fn
        held: list[tuple] = []  # one frame for many short answers
        for frame in frames:
            for row in frame.itertuples(index=False):
                tokens: list[str] = []
                for _ in range(retries + 1):
                    try:
                        for token in call(row.system, row.prompt, row.model):
                            if token:
                                tokens.append(token)
                        break
                    except Exception:
                        continue
                else:
                    if not tokens:
                        tokens = [error_text % row.chunk_index]
                held.extend((row.query_id, row.chunk_index, no, token) for no, token in enumerate(tokens, 1))
                if len(held) >= TOKENS:
                    yield pd.DataFrame(held, columns=names)
                    held = []
        if held:
            yield pd.DataFrame(held, columns=names)

    columns = ["query_id", "chunk_index", "system", "prompt", "model"]
    return requests.select(*columns).mapInPandas(run, schema)


def score_pairs(pairs: DataFrame, fn: Callable | None = None, *, query: str = "text",
                document: str = "document", out: str = "cross_score",
                setup: Callable | None = None) -> DataFrame:
    """Add a score from `fn(list of (query, document)) -> list of scores`."""

    def run(columns: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        call = setup() if setup else fn
        for frame in columns:
            yield pd.Series([float(x) for x in call(list(zip(frame["q"], frame["d"])))], dtype="float64")

    run.__annotations__ = {"columns": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(run, T.DoubleType()).asNondeterministic()
    return pairs.withColumn(out, udf(F.struct(F.col(query).alias("q"), F.col(document).alias("d"))))

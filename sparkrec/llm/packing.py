"""Concatenate and cut: documents' ids in one row of numbers, cut into windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkrec.llm.common import documents, stored, with_base
from sparkrec.llm.tokens import token_rows

WINDOW = 4096


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, *, window: int = WINDOW,
         id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence of at most `window` ids.

    First pass: every task encodes its documents and numbers their ids from 0; the rows
    are stored. Second pass: the totals of the partitions, summed in order, shift these
    numbers to places in the whole corpus; a document is cut where a window ends. No
    document moves between tasks, and a document of any length is cut alike. All
    sequences but the last are full.

    A null or empty text is one piece with the end id alone. Repeated rows are packed as
    often as they occur, rows with a null id too. An empty table gives no rows. Other
    columns of `docs` are not read. `more` marks a piece whose document goes on in the
    next sequence, `ids` (with keep_ids) holds its little-endian 32-bit ids.
    """
    tokens = stored(token_rows(documents(docs, id_col, text_col), tokenizer_path, end_id), "tokens")
    placed = with_base(tokens, "part", F.col("n_ids"), "base").withColumn("at", F.col("base") + F.col("start"))
    first, last = F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("n_ids") - 1) / window)
    cut = placed.withColumn("sequence_id", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    head = F.greatest(F.col("sequence_id") * window - F.col("at"), F.lit(0))
    tail = F.least((F.col("sequence_id") + 1) * window - F.col("at"), F.col("n_ids"))
    cut = cut.withColumns({"piece_start": head, "length": tail - head})
    piece = F.substring("ids", (F.col("piece_start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return cut.select(
        "doc_id", F.col("piece_start").alias("start"), "length", F.crc32(piece).alias("ids_crc32"),
        F.col("n_ids").alias("doc_tokens"), "sequence_id",
        (F.col("at") + F.col("piece_start") - F.col("sequence_id") * window).alias("offset"),
        (F.col("piece_start") + F.col("length") < F.col("n_ids")).alias("more"),
        *([piece.alias("ids")] if keep_ids else []))


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """sequence_id, ids (binary), n_ids and padded_to, from `pack(..., keep_ids=True)`.

    A sequence gathers at most `window` pieces. It is padded to the window, or to the
    next power of two where it is shorter (the last one)."""
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("rows"))
    ids = F.aggregate("rows", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    n = F.floor(F.octet_length("ids") / 4).cast("int")
    power = F.pow(F.lit(2), F.ceil(F.log2(F.col("n_ids")))).cast("int")
    return (rows.select("sequence_id", ids.alias("ids")).withColumn("n_ids", n)
            .withColumn("padded_to", F.least(power, F.lit(window))))

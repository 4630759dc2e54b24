"""Conversations out of reply trees: paths by self-joins, branches by score, one text each.

Column expressions and joins only. The template is

    <s>[role]text</s>

per turn, without anything between turns. In roles and texts "~", "<", "[" and "]" are
written "~0", "~1", "~2" and "~3", so that no text can contain a control string.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sparkrec.llm.common import stored

ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("]", "~3"))
TURN = r"<s>\[([^\]<]*)\]([^<\[]*)</s>"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("null"))


def chain(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Plain conversations as reply trees: each row answers the one before it, in the order
    of turn, then role, then text. Gives conv_id, id, parent, role, text and score (1 each)."""
    order = W.partitionBy(conv).orderBy(turn, role, text)
    rows = turns.select(F.col(conv).alias("conv_id"), F.row_number().over(order).cast("long").alias("id"), role, text)
    return rows.select("conv_id", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"),
                       F.col(role).alias("role"), F.col(text).alias("text"), F.lit(1.0).alias("score"))


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Jumps of 1, 2, 4, ... messages up, and how each message's way to its root ends.

    A level has (key, id, jump) of the messages that have so many above them. It is made
    by joining the one before with what its jumps lead to, so a message takes part only
    until its jumps pass the root. The ends are (key, id, steps, total): the number of
    messages above it, and the scores from it to the root. Messages whose way runs in a
    circle have no end.
    """
    own = nodes.select("key", "id", "parent", "score")
    known = own.select("key", F.col("id").alias("jump"), F.lit(True).alias("known"))
    table = stored(own.withColumnRenamed("parent", "jump").join(known, ["key", "jump"], "left").select(
        "key", "id", F.when(F.col("known"), F.col("jump")).alias("jump"),
        F.when(F.col("known"), 1).otherwise(0).cast("long").alias("steps"), F.col("score").alias("total")), "replies")
    levels, ended = [table.where("jump IS NOT NULL")], [table.where("jump IS NULL")]
    for _ in range(nodes.count().bit_length()):
        low = levels[-1]
        if low.isEmpty():
            break
        to = reduce(DataFrame.union, [low, *ended]).select(
            "key", F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("steps").alias("_steps"),
            F.col("total").alias("_total"))
        table = stored(low.join(to, ["key", "jump"]).select(
            "key", "id", F.col("_jump").alias("jump"), (F.col("steps") + F.col("_steps")).alias("steps"),
            (F.col("total") + F.col("_total")).alias("total")), "replies")
        levels.append(table.where("jump IS NOT NULL"))
        ended.append(table.where("jump IS NULL"))
    return [t.select("key", "id", "jump") for t in levels], reduce(DataFrame.union, ended).drop("jump")


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """key, conv_id, leaf, pos, role and text of the chosen root-to-leaf paths.

    `messages` has conv_id, id, parent, role, text and score; (conv_id, id) is unique. A
    message whose parent is null or absent is a root. Of the leaves of a conversation the
    `branches` with the highest total score on their path are chosen; ties go to the
    longer path, then to the smaller id. All paths grow at once, by jumps of 1, 2, 4, ...
    replies, so a path of n messages takes part in log2(n) joins. Null conversation ids
    are one conversation, a null score counts 0. Messages that answer each other in a
    circle have no root, and neither they nor what answers them is on a path.
    """
    nodes = stored(messages.select(
        _key(F.col("conv_id")).alias("key"), "conv_id", "id", "parent", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "messages")
    levels, ends = _jumps(nodes)
    answered = levels[0].select("key", F.col("jump").alias("id")).distinct()
    best = W.partitionBy("key").orderBy(F.desc("total"), F.desc("steps"), "id")
    chosen = ends.join(answered, ["key", "id"], "left_anti").withColumn("_n", F.row_number().over(best))
    path = stored(chosen.where(F.col("_n") <= branches).select(
        "key", F.col("id").alias("leaf"), "id", F.col("steps").alias("depth"), F.lit(0).cast("long").alias("back")), "paths")
    whole = []
    for k, level in enumerate(levels):
        whole.append(path.where(F.col("depth") < 1 << k))
        path = path.where(F.col("depth") >= 1 << k)
        if path.isEmpty():
            break
        both = F.array(F.struct("id", "back"), F.struct(F.col("jump").alias("id"), (F.col("back") + (1 << k)).alias("back")))
        path = stored(path.join(level, ["key", "id"], "left").select("key", "leaf", "depth", F.explode(both).alias("m"))
                      .select("key", "leaf", "depth", "m.*").where("id IS NOT NULL"), "paths")
    else:
        whole.append(path)
    return reduce(DataFrame.union, [p.select("key", "leaf", "id", "depth", "back") for p in whole]).join(nodes, ["key", "id"]).select(
        "key", "conv_id", "leaf", (F.col("depth") - F.col("back")).alias("pos"), "role", "text")


def format_paths(chosen: DataFrame) -> DataFrame:
    """One row per path: key, conv_id, leaf, formatted, and loss: where the answers' texts
    are in it, as start and length in bytes of UTF-8."""
    head = F.concat(F.lit("<s>["), escape(F.col("role")), F.lit("]"))
    turns = chosen.select("key", "conv_id", "leaf", "pos", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit("</s>")))
    before = W.partitionBy("key", "conv_id", "leaf").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("piece")).over(before), F.lit(0)) + F.octet_length("head")
    turns = turns.select("key", "conv_id", "leaf", F.struct(
        "pos", "piece", (F.col("role") == TRAINED).alias("trained"), start.alias("start"),
        F.octet_length("body").cast("long").alias("length")).alias("turn"))
    rows = turns.groupBy("key", "conv_id", "leaf").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["start"], t["length"]))
    return rows.select("key", "conv_id", "leaf", F.array_join("turns.piece", "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, leaf, roles, texts and learned (all text under the mask, unescaped, joined)."""
    text = F.col("formatted").cast("binary")
    learned = F.transform("loss", lambda s: unescape(
        F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string")))
    parts = formatted.select(
        "conv_id", "leaf", "formatted", F.regexp_extract_all("formatted", F.lit(TURN), F.lit(1)).alias("roles"),
        F.regexp_extract_all("formatted", F.lit(TURN), F.lit(2)).alias("texts"), F.array_join(learned, "").alias("learned"))
    return parts.withColumns({"roles": F.transform("roles", unescape), "texts": F.transform("texts", unescape)})


def digests(formatted: DataFrame) -> DataFrame:
    """Numbers and digests of conversations as they read back from their formatted form."""
    turns = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return read_back(formatted).select(
        "conv_id", F.size("roles").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def conversations(messages: DataFrame, path: str | None = None, branches: int = 1) -> DataFrame:
    """Formatted conversations of `messages`, written (to `path`) and read again.

    Takes rows like `paths`; null roles and texts are empty, a very long conversation is
    one row, an empty table gives none. Other columns are not read.
    """
    return stored(format_paths(paths(messages, branches)), "conversations", path)

"""The registered queries of this package and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkrec.llm import chat, decontam, hard_negatives, iblt, line_dedup, media, packing, pfor, quality, repair, secret_scan, sharding, simhash
from sparkrec.storage import scratch_path

TOKENIZER = "word_bpe_49k.json"
SHARDS = tuple(f"shard-{i:02d}" for i in range(32))
SLOTS = 4099


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its probabilities of good quality and toxicity, and the verdict."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf, "labels"))
    return quality.classify(docs, model).select("doc_id", "quality", "toxicity", "keep")


def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path(TOKENIZER), 2)


def op3_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def _sql_words(t: str) -> str:
    upper = "".join(map(chr, range(65, 91)))
    return (f"regexp_extract_all(translate(coalesce({t}, ''), '{upper}', '{upper.lower()}'), "
            r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


SQL_DECONTAMINATION = f"""WITH w AS (SELECT doc_id, {_sql_words("text")} AS ws FROM documents),
b AS (SELECT item_id, {_sql_words("text")} AS ws FROM benchmark),
bn AS (SELECT *, least({decontam.WINDOW}, len(ws)) AS n FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS win
       FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM bn)),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS win
       FROM (SELECT w.*, ns.n, unnest(range(1, len(ws) - ns.n + 2)) AS i FROM w, (SELECT DISTINCT n FROM bw) ns WHERE len(ws) >= ns.n)),
h AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN hit ON hit.doc_id = w.doc_id LEFT JOIN items ON items.doc_id = w.doc_id"""


def op4_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.report(secret_scan.find_secrets(table(spark, sf, "documents")))


def op5_media(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as WAV files: stored, read back, sniffed and measured."""
    files = media.text_media(table(spark, sf, "documents"))
    seen = media.inspect(files, "media", "declared", keep=("doc_id", "n_bytes"))
    return seen.select(
        "doc_id", "n_bytes", F.col("samples").alias("payload_bytes"), "payload_sha256", "tail_crc32",
        F.col("media_bytes"), "media_sha256", F.col("features").alias("feature"), "actual_type", "corrected", "found")


def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Where each document is, and where it would be with one shard more."""
    docs = table(spark, sf, "documents").select("doc_id")
    placed = sharding.place(docs, SHARDS, SLOTS)
    grown = sharding.place(placed, (*SHARDS, "shard-32"), SLOTS, slot_col="slot", shard_col="grown_shard")
    return grown.select("doc_id", "slot", "shard", "grown_shard",
                        (F.col("shard") != F.col("grown_shard")).alias("moved"))


def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The documents after removal."""
    out = line_dedup.dedup_lines(table(spark, sf, "documents"))
    return out.select("doc_id", "text", "removed_chunks", "removed_chars")


def _sql_owners(name: str, shards: tuple[str, ...]) -> str:
    """The table's filling as a recursion with one step per claim."""
    names = ", ".join(f"'{s}'" for s in shards)
    n = len(shards)
    return f"""
{name}_p AS (SELECT [{names}] AS names),
{name}_o AS (SELECT names, list_transform(names, lambda s: ('0x' || substr(md5(s), 1, 8))::BIGINT % {SLOTS}) AS starts,
  list_transform(names, lambda s: ('0x' || substr(md5(s), 9, 8))::BIGINT % {SLOTS - 1} + 1) AS steps FROM {name}_p),
{name}_r AS (
  SELECT 0 AS claim, list_transform(range({SLOTS}), lambda x: -1) AS owner, list_transform(names, lambda s: -1::BIGINT) AS turn,
         NULL::BIGINT AS nxt FROM {name}_o
  UNION ALL
  SELECT claim + 1,
    list_transform(range({SLOTS}), lambda x: CASE WHEN x = (starts[claim % {n} + 1] + j * steps[claim % {n} + 1]) % {SLOTS}
                                       THEN claim % {n} ELSE owner[x + 1] END),
    list_transform(range({n}), lambda x: CASE WHEN x = claim % {n} THEN j ELSE turn[x + 1] END), j
  FROM (SELECT r.*, o.starts, o.steps, list_filter(range(turn[claim % {n} + 1] + 1, {SLOTS}),
          lambda x: owner[((starts[claim % {n} + 1] + x * steps[claim % {n} + 1]) % {SLOTS} + 1)::INT] < 0)[1] AS j
        FROM {name}_r r, {name}_o o WHERE claim < {SLOTS})),
{name} AS (SELECT unnest(range({SLOTS})) AS slot, unnest(list_transform(owner, lambda x: names[x + 1])) AS shard
  FROM {name}_r, {name}_o WHERE claim = {SLOTS})"""


SQL_SHARDING = f"""WITH RECURSIVE {_sql_owners("t", SHARDS)}, {_sql_owners("g", (*SHARDS, "shard-32"))},
d AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS})::INT AS slot
      FROM documents)
SELECT doc_id, d.slot, t.shard, g.shard AS grown_shard, t.shard <> g.shard AS moved
FROM d JOIN t ON t.slot = d.slot JOIN g ON g.slot = d.slot"""


def op9_chat(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations and one whose texts are control strings."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digests(chat.conversations(chat.chain(rows.unionByName(odd))))


def _sql_escaped(c: str) -> str:
    for plain, code in chat.ESCAPES:
        c = f"replace({c}, '{plain}', '{code}')"
    return c


SQL_CHAT = f"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum(length({_sql_escaped("role")}) + length({_sql_escaped("text")}) + length('<s>[]</s>'))::BIGINT AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars FROM g"""


def op10_token_ids(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    pfor.write_ids(table(spark, sf, "documents"), path, public_tokenizers.path(TOKENIZER), 1)
    return pfor.read_ids(spark, path)


def op11_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Every document against its edited version and the next document."""
    return iblt.revisions(table(spark, sf, "documents"))


def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of every seventh row are moved on by one; every hundredth row is an anchor."""
    rows = table(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), anchor=F.col("vec_id") % 100 == 0)


SQL_HARD_NEGATIVES = """WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 5"""


def op13_repair(spark: SparkSession, sf: str) -> DataFrame:
    return repair.repair(table(spark, sf, "conversations"), damage=True)


# Rows after damage with their faults (w), the cheapest edits of each prefix and state (dp: 0
# nothing yet, 1 system, 2 user, 3 assistant came last), and the edits played back (o).
SQL_REPAIR = r"""WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(k, ''),
        lambda ch: list_transform(range(8), lambda b: ((ord(ch) >> b) & 1)::BIGINT))),
        lambda x, b: xor(x >> 1, CASE WHEN (xor(x, b) & 1) = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 20 AS r FROM c),
d AS (SELECT conv_id, turn, CASE WHEN r = 4 THEN 'user' ELSE role END AS role,
        CASE r WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN r = 3 THEN 2 ELSE 1 END)) AS copy
      FROM h WHERE r <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n, role[1] AS i FROM d),
w AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
                     WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault,
             lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair FROM n),
puts(a, b, put) AS (VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')),
nexts(b, z, i) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')),
dp AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS n, 0 AS z, {'cost': 0, 'audit': ''} AS best FROM c
  UNION ALL
  SELECT conv_id, n, z, min({'cost': cost, 'audit': audit}) FROM (
    SELECT dp.conv_id, w.n, p.b AS z, dp.best.cost + 3 * len(put) + 4 AS cost, dp.best.audit || put || 'D' AS audit
    FROM dp JOIN w ON w.conv_id IS NOT DISTINCT FROM dp.conv_id AND w.n = dp.n + 1 JOIN puts p ON p.a = dp.z
    UNION ALL
    SELECT dp.conv_id, w.n, x.z, dp.best.cost + 3 * len(put) + w.fault + CASE WHEN w.i = x.i THEN 0 ELSE 3 END,
           dp.best.audit || put || CASE WHEN w.i = x.i THEN 'K' ELSE 'R' END
    FROM dp JOIN w ON w.conv_id IS NOT DISTINCT FROM dp.conv_id AND w.n = dp.n + 1 JOIN puts p ON p.a = dp.z
      JOIN nexts x ON x.b = p.b AND (x.i <> 's' OR w.i = 's') WHERE w.fault IN (0, 3)) GROUP BY ALL),
e AS (SELECT conv_id, min({'cost': best.cost + 3 * close, 'audit': best.audit || repeat('I', close)}) AS best
      FROM (SELECT *, max(n) OVER (PARTITION BY conv_id) AS last, CASE z WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS close FROM dp)
      WHERE n = last GROUP BY conv_id),
a AS (SELECT conv_id, best.audit AS audit, unnest(range(1, len(best.audit) + 1)) AS j FROM e),
o AS (SELECT conv_id, j, audit[j] AS edit, len(replace(audit[:j], 'I', '')) AS n, len(replace(audit[:j], 'D', '')) AS k FROM a WHERE audit[j] <> 'D'),
r AS (SELECT o.conv_id, o.j, o.k, edit, w.role, coalesce(CASE WHEN edit <> 'I' THEN w.text END, '') AS text,
        bool_or(o.k = 1 AND edit = 'K' AND w.i = 's') OVER (PARTITION BY o.conv_id) AS led
      FROM o LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM o.conv_id AND w.n = o.n),
f AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (k + led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
             chr(10) ORDER BY j) AS repaired, count(*) AS n_repaired FROM r GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
        count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM w GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.cost::BIGINT AS cost, best.audit AS audit,
  sha256(coalesce(repaired, '')) AS repaired_sha256, coalesce(n_repaired, 0) AS n_repaired
FROM e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id"""


QUERIES = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_decontamination": op3_decontamination,
    "op4_secrets": op4_secrets,
    "op5_media": op5_media,
    "op6_simhash": op6_simhash,
    "op7_sharding": op7_sharding,
    "op8_line_dedup": op8_line_dedup,
    "op9_chat": op9_chat,
    "op10_token_ids": op10_token_ids,
    "op11_fingerprints": op11_fingerprints,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_repair": op13_repair,
}

ORACLE = {
    "op3_decontamination": SQL_DECONTAMINATION,
    "op7_sharding": SQL_SHARDING,
    "op9_chat": SQL_CHAT,
    "op12_hard_negatives": SQL_HARD_NEGATIVES,
    "op13_repair": SQL_REPAIR,
}

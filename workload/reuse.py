"""Cache keys, memoised calls and age-limited reuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrec import constants as K
from sparkrec.functions import prompts
from sparkrec.functions.times import micros
from sparkrec.operators import cache
from sparkrec.operators.models import generate
from workload.base import quoted, stand_in_answer, table

SIX_HOURS = 6 * 3600


def _requests(spark, sf):
    """Every message as a request; system messages ask for two keys."""
    keys = F.when(F.col("role") == "system", F.array(F.lit("title"), F.lit("summary")))
    rows = table(spark, sf, "conversations").withColumn("keys", keys)
    rows = rows.withColumns({
        "prompt": F.col("text"),
        "system": prompts.with_schema_hint(F.lit(K.ANSWER_SYSTEM), F.coalesce("keys", F.array().cast("array<string>"))),
        "model": prompts.first_set(F.when(F.col("role") == "user", F.lit("")), F.lit("default"))})
    return rows.withColumn("cache_key", prompts.cache_key(
        F.col("prompt"), F.col("system"), F.col("model"), F.col("keys")))


def cache_keys(spark, sf):
    return _requests(spark, sf).groupBy("cache_key").agg(F.count(F.lit(1)).alias("n_requests"))


def memoised(spark, sf):
    requests = _requests(spark, sf).select("conv_id", "turn", "cache_key", "system", "prompt", "model")
    done = cache.memoise(requests, lambda unique: generate(unique, stand_in_answer, retries=1))
    return done.select("conv_id", "turn", "response", "error")


_HINT = K.ANSWER_SYSTEM + "\n\n" + K.SCHEMA_HINT + "title, summary."
_SQL_KEY = f"""CASE WHEN role = 'system' THEN sha256(text || '|' || {quoted(_HINT)} || '|default|["title", "summary"]')
     ELSE sha256(text || '|' || {quoted(K.ANSWER_SYSTEM)} || '|default|[]') END"""


def _events(spark, sf, key):
    return table(spark, sf, "events").select(
        F.col(key).alias("cache_key"), F.col("ts"), F.col("event_id").alias("request_id"), "event_type")


def _timed(df):
    return df.select("request_id", "computed", micros(df, "entry_ts").alias("entry_us"))


def ttl_reuse(spark, sf):
    return _timed(cache.ttl_reuse(_events(spark, sf, "user_id"), SIX_HOURS))


def ttl_reuse_hot(spark, sf):
    """Five keys hold all requests; blocks are short and their tree has several levels."""
    return _timed(cache.ttl_reuse(_events(spark, sf, "event_type"), 1800, block_windows=8, fan=4))


def ttl_reuse_failures(spark, sf):
    """Calls of one kind fail and are not stored."""
    rows = _events(spark, sf, "user_id").withColumn("ok", F.col("event_type") != "error")
    return _timed(cache.ttl_reuse(rows, SIX_HOURS))


def _sql_ttl(key: str, seconds: int, stored: str = "true") -> str:
    us = seconds * 1_000_000
    return f"""
WITH RECURSIVE r AS (SELECT {key} AS k, epoch_us(ts) AS us, event_id AS id, {stored} AS ok FROM events),
t AS (SELECT k, us, min(id) AS id FROM r WHERE ok GROUP BY k, us),
e AS (SELECT k, min(us) AS us FROM t GROUP BY k
      UNION ALL SELECT e.k, min(t.us) FROM e JOIN t ON t.k = e.k AND t.us > e.us + {us} GROUP BY e.k),
en AS (SELECT t.* FROM e JOIN t USING (k, us)),
x AS (SELECT r.id, max(en.us) AS entry_us FROM r LEFT JOIN en ON en.k = r.k AND r.us - en.us BETWEEN 0 AND {us}
      AND (en.us, en.id) < (r.us, r.id) GROUP BY r.id)
SELECT x.id AS request_id, entry_us IS NULL AS computed,
       coalesce(entry_us, (SELECT max(en.us) FROM en WHERE en.id = x.id)) AS entry_us FROM x"""


def _looked_up(spark, sf, key, seconds):
    rows = table(spark, sf, "events").withColumn("cache_key", key)
    stored = rows.where("event_type = 'purchase'").select(
        "cache_key", "ts", F.col("event_id").cast("string").alias("response"))
    asked = rows.where("event_type = 'click'").select("cache_key", "ts", "event_id")
    found = cache.cache_lookup(asked, stored, seconds)
    return found.select("event_id", "response", micros(found, "entry_ts").alias("entry_us"))


def cache_lookup(spark, sf):
    """Clicks look for the newest purchase of the same user within six hours."""
    return _looked_up(spark, sf, F.col("user_id"), SIX_HOURS)


def cache_lookup_hot(spark, sf):
    """One key holds all requests and entries."""
    return _looked_up(spark, sf, F.lit(1).cast("long"), 1800)


QUERIES = {
    "cache_keys": cache_keys,
    "memoised_answers": memoised,
    "ttl_reuse": ttl_reuse,
    "ttl_reuse_hot": ttl_reuse_hot,
    "ttl_reuse_failures": ttl_reuse_failures,
    "cache_lookup": cache_lookup,
    "cache_lookup_hot": cache_lookup_hot,
}

ORACLE = {
    "cache_keys": f"SELECT {_SQL_KEY} AS cache_key, count(*) AS n_requests FROM conversations GROUP BY 1",
    "memoised_answers": """SELECT conv_id, turn, CASE WHEN right(h, 1) <> '0' THEN 'answer ' || h END AS response,
        CASE WHEN right(h, 1) = '0' THEN 'RuntimeError: no answer' END AS error
        FROM (SELECT *, sha256(text) AS h FROM conversations)""",
    "ttl_reuse": _sql_ttl("user_id", SIX_HOURS),
    "ttl_reuse_hot": _sql_ttl("event_type", 1800),
    "ttl_reuse_failures": _sql_ttl("user_id", SIX_HOURS, "event_type <> 'error'"),
    "cache_lookup": f"""WITH p AS (SELECT user_id, epoch_us(ts) AS us, event_id FROM events WHERE event_type = 'purchase'),
        x AS (SELECT c.event_id, max(p.us) AS entry_us, arg_max(p.event_id, p.us) AS r FROM events c LEFT JOIN p
              ON p.user_id = c.user_id AND epoch_us(c.ts) - p.us BETWEEN 0 AND {SIX_HOURS * 1_000_000}
              WHERE c.event_type = 'click' GROUP BY c.event_id)
        SELECT event_id, r::VARCHAR AS response, entry_us FROM x""",
    "cache_lookup_hot": """WITH p AS (SELECT epoch_us(ts) AS us, max(event_id::VARCHAR) AS r FROM events
          WHERE event_type = 'purchase' GROUP BY 1),
        x AS (SELECT event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click')
        SELECT event_id, CASE WHEN x.us - p.us <= 1800000000 THEN r END AS response,
               CASE WHEN x.us - p.us <= 1800000000 THEN p.us END AS entry_us FROM x ASOF LEFT JOIN p ON x.us >= p.us""",
}

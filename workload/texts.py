"""Query expansion, text columns, the research table and categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkrec import constants as K
from sparkrec.functions import prompts, scores, text
from sparkrec.functions.jsonio import coerce_parts, is_valid_json
from sparkrec.operators import dimension, expand
from sparkrec.operators.filters import split_prompts
from sparkrec.sources import research
from sparkrec.sources.prompts import as_queries, read_prompts
from sparkrec.storage import scratch_path
from workload.base import quoted, sql_strip, table, user_prompts

# --- expansion ------------------------------------------------------------------


def raw_responses(spark, sf):
    """What models might answer to the users' prompts, good and bad."""
    asked = user_prompts(spark, sf)
    t, q = F.col("text"), F.col("query_id")
    fenced = lambda c: F.concat(F.lit("```json\n"), c, F.lit("\n```"))
    hyde = F.when(q % 7 == 1, "  \n ").otherwise(F.concat(F.lit("\tAbout "), t, F.lit("\n")))
    full = F.to_json(F.struct(
        F.concat(F.lit("General: "), t).alias("abstracted_query"),
        F.array(F.lit("cs.LG"), F.lit("cs.CL")).alias("categories"),
        F.lit("high").alias("confidence"), F.lit("because").alias("reasoning")))
    back = (F.when(q % 9 == 0, fenced(full)).when(q % 9 == 1, F.concat(full, F.lit(" and more")))
            .when(q % 9 == 2, F.lit('{"abstracted_query": "x", "categories": []}'))
            .when(q % 9 == 3, F.lit("[1, 2]")).when(q % 9 == 4, F.lit("5")).when(q % 9 == 5, F.lit(""))
            .when(q % 9 == 6, F.lit('{"abstracted_query": null, "categories": ["cs.AI"], "confidence": "low"}'))
            .otherwise(full))
    items = F.array(t, F.concat(F.lit("a "), t), F.concat(F.lit(" b "), t), F.concat(F.lit("a "), t),
                    F.lit("c"), F.lit("d"), F.lit("e"))
    listed = F.to_json(items)
    fusion = (F.when(q % 8 == 0, fenced(listed)).when(q % 8 == 1, F.concat(listed, F.lit(" extra")))
              .when(q % 8 == 2, F.lit('{"a": ["x"]}')).when(q % 8 == 3, F.lit('["one", "two", 3, "four"]'))
              .when(q % 8 == 4, F.lit("[]")).when(q % 8 == 5, F.expr("substr(j, 1, length(j) - 1)"))
              .otherwise(F.lit(None).cast("string")))
    rows = asked.withColumn("j", listed).withColumns({
        "hyde": hyde, "step_back": back,
        "fusion": F.when(q % 8 < 6, fusion).otherwise(listed)})
    entry = lambda kind, failed: F.struct(
        F.lit(kind).alias("kind"), F.when(~failed, F.col(kind)).alias("response"),
        F.when(failed, "timeout").alias("error"))
    return rows.select("query_id", F.inline(F.array(
        entry("hyde", q % 7 == 0), entry("step_back", q % 9 == 7), entry("fusion", q % 8 == 6))))


def expanded(spark, sf):
    return expand.expand_queries(user_prompts(spark, sf), raw_responses(spark, sf))


def step_back_records(spark, sf):
    parsed = expand.parse_responses(user_prompts(spark, sf), raw_responses(spark, sf))
    return parsed.select("query_id", "step_back.abstracted_query",
                         F.array_join("step_back.categories", ",").alias("categories"),
                         "step_back.confidence", "step_back.reasoning", "step_back.outcome")


def expansion_requests(spark, sf):
    rows = expand.expansion_requests(user_prompts(spark, sf))
    return rows.select("query_id", "kind", F.sha2("system", 256).alias("system_hash"),
                       F.sha2("prompt", 256).alias("prompt_hash"))


_SQL_RAW = """
u AS (SELECT conv_id * 1000 + turn AS query_id,
      CASE WHEN (conv_id * 1000 + turn) % 5 = 0 THEN ' ' || chr(9) || text || chr(160) || chr(10) ELSE text END AS text
      FROM conversations WHERE role = 'user'),
j AS (SELECT *, to_json([text, 'a ' || text, ' b ' || text, 'a ' || text, 'c', 'd', 'e'])::VARCHAR AS listed,
      to_json({abstracted_query: 'General: ' || text, categories: ['cs.LG', 'cs.CL'], confidence: 'high', reasoning: 'because'})::VARCHAR AS full_record,
      FROM u),
raw AS (SELECT query_id, text,
      CASE WHEN query_id % 7 = 0 THEN NULL WHEN query_id % 7 = 1 THEN '  ' || chr(10) || ' ' ELSE chr(9) || 'About ' || text || chr(10) END AS hyde,
      CASE query_id % 9 WHEN 7 THEN NULL WHEN 0 THEN '```json' || chr(10) || full_record || chr(10) || '```'
        WHEN 1 THEN full_record || ' and more' WHEN 2 THEN '{"abstracted_query": "x", "categories": []}' WHEN 3 THEN '[1, 2]'
        WHEN 4 THEN '5' WHEN 5 THEN '' WHEN 6 THEN '{"abstracted_query": null, "categories": ["cs.AI"], "confidence": "low"}'
        ELSE full_record END AS back,
      CASE query_id % 8 WHEN 6 THEN NULL WHEN 0 THEN '```json' || chr(10) || listed || chr(10) || '```' WHEN 1 THEN listed || ' extra'
        WHEN 2 THEN '{"a": ["x"]}' WHEN 3 THEN '["one", "two", 3, "four"]' WHEN 4 THEN '[]'
        WHEN 5 THEN substr(listed, 1, length(listed) - 1) ELSE listed END AS fusion FROM j)"""


def _clean(c: str) -> str:
    return sql_strip(f"replace(replace({sql_strip(c)}, '```json', ''), '```', '')")


_SQL_PARSED = f"""WITH {_SQL_RAW},
t AS (SELECT query_id, text, coalesce({sql_strip('hyde')}, '') AS hyde, {_clean('back')} AS back, {_clean('fusion')} AS fusion FROM raw),
k AS (SELECT *, CASE WHEN back IS NULL THEN 'call' WHEN NOT json_valid(back) THEN 'parse'
      WHEN json_type(back) = 'OBJECT' THEN CASE WHEN list_has_all(json_keys(back), ['abstracted_query', 'categories', 'confidence']) THEN 'parsed' ELSE 'parse' END
      WHEN json_type(back) IN ('ARRAY', 'VARCHAR') THEN 'parse' ELSE 'none' END AS outcome FROM t),
r AS (SELECT *, CASE WHEN outcome = 'parsed' THEN CASE WHEN json_type(back, '$.abstracted_query') = 'VARCHAR' THEN back ->> '$.abstracted_query' END
      WHEN outcome = 'none' THEN NULL ELSE text END AS abstracted FROM k)"""

_SQL_EXPAND = _SQL_PARSED + f""",
f AS (SELECT query_id, text, CASE WHEN fusion IS NOT NULL AND json_valid(fusion) AND json_type(fusion) = 'ARRAY'
      THEN json_extract(fusion, '$[*]') ELSE [] END AS items FROM r),
fi AS (SELECT query_id, text, unnest(items) AS item, generate_subscripts(items, 1) AS i FROM f),
ff AS (SELECT query_id, text, json_type(item) = 'VARCHAR' AS is_text, item ->> '$' AS v,
       row_number() OVER (PARTITION BY query_id ORDER BY i) AS n FROM fi WHERE NOT (json_type(item) = 'VARCHAR' AND (item ->> '$') = text)),
fb AS (SELECT *, min(CASE WHEN NOT is_text THEN n END) OVER (PARTITION BY query_id) AS bad FROM ff WHERE n <= 4),
fl AS (SELECT query_id, 0 AS n, text AS v FROM r UNION ALL SELECT query_id, n, v FROM fb WHERE bad IS NULL OR n < bad),
early AS (SELECT query_id, 1 AS a, 0 AS n, 'query' AS kind, text FROM r
      UNION ALL SELECT query_id, 2, 0, 'hyde', hyde FROM r WHERE hyde <> ''
      UNION ALL SELECT query_id, 3, 0, 'step_back', {sql_strip('abstracted')} FROM r
                WHERE {sql_strip('abstracted')} <> '' AND {sql_strip('abstracted')} <> text),
late AS (SELECT query_id, 4 AS a, min(n) AS n, 'fusion' AS kind, {sql_strip('v')} AS text FROM fl WHERE {sql_strip('v')} <> ''
         GROUP BY query_id, {sql_strip('v')}),
al AS (SELECT * FROM early UNION ALL SELECT * FROM late
       WHERE NOT EXISTS (SELECT 1 FROM early e WHERE e.query_id = late.query_id AND e.text = late.text))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY a, n) - 1)::INT AS variant_no, kind, text FROM al"""

_SQL_BACK = _SQL_PARSED + f"""
SELECT query_id, abstracted AS abstracted_query,
       CASE WHEN outcome = 'parsed' THEN array_to_string(json_extract_string(back, '$.categories[*]'), ',') ELSE '' END AS categories,
       CASE outcome WHEN 'parsed' THEN back ->> '$.confidence' WHEN 'none' THEN NULL ELSE 'low' END AS confidence,
       CASE outcome WHEN 'parsed' THEN back ->> '$.reasoning' WHEN 'none' THEN NULL
            WHEN 'call' THEN {quoted(K.CALL_FALLBACK % 'timeout')} ELSE {quoted(K.PARSE_FALLBACK)} END AS reasoning,
       CASE WHEN outcome IN ('call', 'parse') THEN 'fallback' ELSE outcome END AS outcome FROM r"""

_SQL_REQUESTS = f"""WITH {_SQL_RAW}
SELECT query_id, 'hyde' AS kind, sha256({quoted(prompts.expansion_system('hyde', 4))}) AS system_hash, sha256(text) AS prompt_hash FROM u
UNION ALL SELECT query_id, 'step_back', sha256({quoted(prompts.expansion_system('step_back', 4))}), sha256('User query: ' || text) FROM u
UNION ALL SELECT query_id, 'fusion', sha256({quoted(prompts.expansion_system('fusion', 4))}), sha256('Original query: ' || text) FROM u"""

# --- text columns ---------------------------------------------------------------


def cleaned_texts(spark, sf):
    """Pages' markup with blanks around, fenced in part: cleaned and stripped."""
    dirty = F.concat(F.lit(" \t "), F.when(F.col("page_id") % 2 == 0, "```json\n").otherwise(""),
                     "html", F.when(F.col("page_id") % 2 == 0, "\n``` ").otherwise("\n"), F.lit("\u00a0"))
    rows = table(spark, sf, "pages").select("page_id", dirty.alias("t"))
    return rows.select("page_id", F.sha2(text.strip(F.col("t")), 256).alias("stripped"),
                       F.sha2(text.strip_fences(F.col("t")), 256).alias("unfenced"),
                       F.sha2(text.clean_newlines(F.col("t")), 256).alias("one_line"))


_SQL_DIRTY = """(SELECT page_id, ' ' || chr(9) || ' ' || CASE WHEN page_id % 2 = 0 THEN '```json' || chr(10) ELSE '' END || html
      || CASE WHEN page_id % 2 = 0 THEN chr(10) || '``` ' ELSE chr(10) END || chr(160) AS t FROM pages)"""


def words(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(F.array_sort(text.terms(F.col("text"))), " ").alias("words"))


def json_validity(spark, sf):
    """Event properties, whole, cut and followed by more, as model output."""
    p, k = F.col("props"), F.col("event_id") % 4
    out = (F.when(k == 0, p).when(k == 1, F.concat(p, F.lit(" ok"))).when(k == 2, F.expr("substr(props, 1, length(props) - 1)"))
           .otherwise(F.concat(F.lit("["), p, F.lit(", null]"))))
    return table(spark, sf, "events").select("event_id", is_valid_json(out).alias("valid"))


def display_documents(spark, sf):
    """Even documents as JSON records, odd ones as plain text."""
    record = F.to_json(F.struct(F.col("text").alias("title"), F.col("lang").alias("category"),
                                F.col("text").alias("summary"), F.col("source").alias("authors")))
    document = F.when(F.col("doc_id") % 2 == 0, record).otherwise(F.col("text"))
    meta = F.create_map(F.lit("categories"), F.col("lang"), F.lit("source"), F.col("source"))
    card = text.display_document(document, meta)
    return table(spark, sf, "documents").select("doc_id", card.alias("c")).select("doc_id", "c.*")


def score_formats(spark, sf):
    value = F.col("value")
    score = F.when(F.col("event_type") != "error", value / 100)
    return table(spark, sf, "events").select(
        "event_id", text.percent(score).alias("percent"), text.score_band(score).alias("band"),
        scores.elapsed_ms(value).alias("elapsed_ms"))


def prompt_source(spark, sf):
    """Messages stored as JSON requests (some blank or without text), read and split."""
    text_ = (F.when(F.col("turn") % 4 == 1, F.lit("")).when(F.col("turn") % 4 == 2, F.lit(" \t"))
             .when(F.col("role") != "system", F.col("text")))
    path = scratch_path(spark, "prompts")
    table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), text_.alias("input_prompt")).write.json(path)
    asked = read_prompts(spark, path, "query_id long, input_prompt string")
    accepted, rejected = split_prompts(as_queries(asked))
    _, strictly = split_prompts(as_queries(asked), strict=True)
    return (accepted.select("query_id", F.lit("accepted").alias("outcome"), F.length("text").alias("n_chars"))
            .unionByName(rejected.select("query_id", F.col("error").alias("outcome"), F.length("text").alias("n_chars")))
            .unionByName(strictly.select("query_id", F.lit("rejected by client").alias("outcome"),
                                         F.length("text").alias("n_chars"))))


def response_parts(spark, sf):
    """Messages as lists of parts, some parts without text, put together again."""
    parts = F.transform(F.split("text", "\\. "), lambda x: F.struct(
        F.when(F.length(x) % 7 != 0, x).alias("text"), F.length(x).alias("n")))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.sha2(coerce_parts(parts), 256).alias("text_hash"))


# --- research table and categories --------------------------------------------------


def research_rows(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.substring("text", 1, 255).alias("title"), F.col("lang").alias("category"),
        F.col("text").alias("summary"), F.col("source").alias("authors"))


_SQL_RESEARCH = """(SELECT doc_id AS id, substr(text, 1, 255) AS title, lang AS category, text AS summary, source AS authors
      FROM documents)"""


def research_page(spark, sf):
    return research.page(research_rows(spark, sf), 3)


def research_deep_page(spark, sf):
    """A page far down, of ids that differ only beyond what a double can tell apart."""
    rows = research_rows(spark, sf).withColumn("id", F.col("id") + (1 << 60))
    return research.page(rows, 18)


def research_pages(spark, sf):
    """Every row with its page."""
    return research.all_pages(research_rows(spark, sf)).select(
        "id", "category", "authors", "page", "place")


def research_stored(spark, sf):
    """The table written as Parquet and read by its declared schema."""
    path = scratch_path(spark, "research")
    research_rows(spark, sf).withColumn("extra", F.lit(1)).write.parquet(path)
    return research.read_research(spark, path).select("id", F.length("title").alias("n_title"), "category",
                                                      F.sha2("summary", 256).alias("summary_hash"), "authors")


def _repeated_keys(spark, sf):
    """Seven rows to a key; a twelfth of the rows has none."""
    key = F.when(F.col("id") % 12 > 0, F.floor(F.col("id") / 7).cast("long"))
    return research_rows(spark, sf).withColumn("id", key)


def research_index_pages(spark, sf):
    """Pages out of an ordered table with counts of its ranges: the first, one in the middle,
    the last, and the one behind it."""
    path = scratch_path(spark, "ordered")
    research.write_ordered(_repeated_keys(spark, sf), path, ranges=8)
    last = -(-spark.read.parquet(f"{path}/rows").count() // 10)
    pages = [research.page_of(spark, path, n).withColumn("page", F.lit(n).cast("long")) for n in (1, last // 2, last, last + 1)]
    rows = pages[0].union(pages[1]).union(pages[2]).union(pages[3])
    return rows.groupBy("page", "id").agg(F.count(F.lit(1)).alias("n"))


def research_repeated_keys(spark, sf):
    """Where the pages of a table with repeated and missing keys begin and end."""
    rows = research.all_pages(_repeated_keys(spark, sf))
    return rows.groupBy("page", "id").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first_place"))


def research_lengths(spark, sf):
    rows = research_rows(spark, sf).withColumn("title", F.col("summary"))
    return research.length_violations(rows).select("id", F.array_join("too_long", ",").alias("too_long"))


_LANGUAGES = (("en", "English"), ("fr", "French"), ("de", "German"))


def category_names(spark, sf):
    """Documents per language; the dimension lacks one of the languages."""
    rows = table(spark, sf, "documents").groupBy(F.col("lang").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return dimension.name_categories(rows, dimension.category_table(spark, _LANGUAGES))


def category_unknown(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("lang").alias("code"))
    return dimension.unknown_categories(rows, dimension.category_table(spark, _LANGUAGES))


def category_list(spark, sf):
    """The rendered list of the languages in the documents, by name."""
    codes = table(spark, sf, "documents").groupBy(F.col("lang").alias("code")).agg(F.min("source").alias("name"))
    return dimension.render_categories(codes.withColumn("seq", F.col("code")))


_SQL_PAGES = """WITH k AS (SELECT CASE WHEN doc_id % 12 > 0 THEN doc_id // 7 END AS id FROM documents),
p AS (SELECT id, (row_number() OVER (ORDER BY id NULLS FIRST) - 1) // 10 + 1 AS page,
      (row_number() OVER (ORDER BY id NULLS FIRST) - 1) % 10 + 1 AS place FROM k)"""

QUERIES = {
    "expand_variants": expanded,
    "step_back_records": step_back_records,
    "expansion_requests": expansion_requests,
    "cleaned_texts": cleaned_texts,
    "words": words,
    "json_validity": json_validity,
    "display_doc": display_documents,
    "score_formats": score_formats,
    "prompt_source": prompt_source,
    "response_parts": response_parts,
    "research_page": research_page,
    "research_deep_page": research_deep_page,
    "research_pages": research_pages,
    "research_stored": research_stored,
    "research_index_pages": research_index_pages,
    "research_repeated_keys": research_repeated_keys,
    "research_lengths": research_lengths,
    "category_dim": category_names,
    "category_unknown": category_unknown,
    "category_list": category_list,
}

ORACLE = {
    "expand_variants": _SQL_EXPAND,
    "step_back_records": _SQL_BACK,
    "expansion_requests": _SQL_REQUESTS,
    "cleaned_texts": f"""SELECT page_id, sha256({sql_strip('t')}) AS stripped, sha256({_clean('t')}) AS unfenced,
        sha256(replace(t, chr(10), ' ')) AS one_line FROM {_SQL_DIRTY}""",
    "words": r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))), ' ') AS words
        FROM documents""",
    "json_validity": """SELECT event_id, json_valid(CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN props || ' ok'
        WHEN 2 THEN substr(props, 1, length(props) - 1) ELSE '[' || props || ', null]' END) AS valid FROM events""",
    "display_doc": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE substr(text, 1, 120) END AS title,
        lang AS category, CASE WHEN doc_id % 2 = 0 THEN text ELSE substr(text, 1, 300) END AS summary,
        CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS authors FROM documents""",
    "score_formats": """SELECT event_id, coalesce(floor(s * 100 + 0.5::DOUBLE)::BIGINT || '%', '—') AS percent,
        CASE WHEN s IS NULL THEN 'muted' WHEN s >= 0.7::DOUBLE THEN 'high' WHEN s >= 0.4::DOUBLE THEN 'mid' ELSE 'low' END AS band,
        round_even(value * 1000, 0)::BIGINT AS elapsed_ms
        FROM (SELECT *, CASE WHEN event_type <> 'error' THEN value / 100 END AS s FROM events)""",
    "prompt_source": """WITH p AS (SELECT conv_id * 1000 + turn AS query_id, CASE turn % 4 WHEN 1 THEN '' WHEN 2 THEN ' ' || chr(9)
            ELSE CASE WHEN role <> 'system' THEN text END END AS t FROM conversations)
        SELECT query_id, CASE WHEN t <> '' THEN 'accepted' ELSE 'input_prompt is required' END AS outcome, length(t)::INT AS n_chars FROM p
        UNION ALL SELECT query_id, 'rejected by client', length(t)::INT FROM p WHERE t IS NULL OR trim(t, ' ' || chr(9)) = ''""",
    "response_parts": """SELECT conv_id, turn, sha256(array_to_string(list_transform(string_split(text, '. '),
        lambda x: CASE WHEN length(x) % 7 <> 0 THEN x ELSE '{"n":' || length(x) || '}' END), chr(10))) AS text_hash FROM conversations""",
    "research_page": f"SELECT * FROM {_SQL_RESEARCH} ORDER BY id LIMIT 10 OFFSET 20",
    "research_deep_page": f"""SELECT * REPLACE (id + 1152921504606846976 AS id) FROM {_SQL_RESEARCH}
        ORDER BY id LIMIT 10 OFFSET 170""",
    "research_pages": f"""SELECT id, category, authors, (row_number() OVER (ORDER BY id) - 1) // 10 + 1 AS page,
        ((row_number() OVER (ORDER BY id) - 1) % 10 + 1)::INT AS place FROM {_SQL_RESEARCH}""",
    "research_stored": f"""SELECT id, length(title)::INT AS n_title, category, sha256(summary) AS summary_hash, authors FROM {_SQL_RESEARCH}""",
    "research_index_pages": _SQL_PAGES + """ SELECT page, id, count(*) AS n FROM p
        WHERE page IN (1, (SELECT max(page) // 2 FROM p), (SELECT max(page) FROM p)) GROUP BY page, id""",
    "research_repeated_keys": _SQL_PAGES + """ SELECT page, id, count(*) AS n, min(place)::INT AS first_place FROM p GROUP BY page, id""",
    "research_lengths": "SELECT doc_id AS id, 'title' AS too_long FROM documents WHERE length(text) > 255",
    "category_dim": """SELECT lang AS code, count(*) AS n, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French'
        WHEN 'de' THEN 'German' END AS name, lang IN ('en', 'fr', 'de') AS known FROM documents GROUP BY lang""",
    "category_unknown": "SELECT lang AS code, count(*) AS n FROM documents WHERE lang NOT IN ('en', 'fr', 'de') GROUP BY lang",
    "category_list": """SELECT string_agg('  ' || lang || ': ' || name, chr(10) ORDER BY lang) AS category_list
        FROM (SELECT lang, min(source) AS name FROM documents GROUP BY lang)""",
}

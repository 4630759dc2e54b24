import json
import re

import pytest
from pyspark.sql import functions as F

from sparkrec.functions import jsonio, prompts, scores, text


def one(spark, value, expr, type_="string"):
    return spark.createDataFrame([(value,)], f"v {type_}").select(expr(F.col("v")).alias("r")).first()["r"]


BLANKS = ["", " ", "\t\n", "  a b \n", " x　", "\x1cy\x1f", "\x85z ", "no", "a​ ", "﻿q"]


def each(spark, values, expr, type_="string"):
    """Results of the expression over all values, in one job."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {type_}").coalesce(1)
    return [r["r"] for r in df.select("i", expr(F.col("v")).alias("r")).orderBy("i").collect()]


def test_strip_is_unicode_strip(spark):
    assert each(spark, BLANKS, text.strip) == [v.strip() for v in BLANKS]


def test_client_strip_takes_byte_order_mark(spark):
    assert one(spark, "﻿ x ", text.strip_client) == "x"
    assert one(spark, "\x1cx", text.strip_client) == "\x1cx"


def test_fences(spark):
    assert one(spark, ' ```json\n["a"]\n``` ', text.strip_fences) == '["a"]'
    assert one(spark, "a```b```jsonc", text.strip_fences) == "abc"


def test_newlines_become_blanks(spark):
    assert one(spark, "a\nb\r\nc\t", text.clean_newlines) == "a b\r c\t"


@pytest.mark.parametrize("value", ["Été É x_1 x²", "don't stop", "", "日本 語", "áb", "A a B"])
def test_terms(spark, value):
    import re
    want = []
    for w in re.findall(r"\w+", value.lower()):
        if w not in want:
            want.append(w)
    assert one(spark, value, text.terms) == want


@pytest.mark.parametrize("value,shown,band", [
    (None, "—", "muted"), (0.0, "0%", "low"), (0.4, "40%", "mid"), (0.7, "70%", "high"),
    (0.125, "13%", "low"), (1.0, "100%", "high")])
def test_percent_and_band(spark, value, shown, band):
    assert one(spark, value, text.percent, "double") == shown
    assert one(spark, value, text.score_band, "double") == band


@pytest.mark.parametrize("document,title", [
    ('{"title": "T", "summary": "S"}', "T"), ('{"title": ""}', '{"title": ""}'), ('{"title": 0}', '{"title": 0}'),
    ('{"title": 5}', "5"), ('{"title": false}', '{"title": false}'), ("plain", "plain"), ("[1]", "[1]"),
    ('{"title": "T"} x', '{"title": "T"} x'), ("e" * 119 + "\U0001f600" + "f", "e" * 119 + "\U0001f600")])
def test_display_document(spark, document, title):
    df = spark.createDataFrame([(document, {"categories": "cs.LG"})], "d string, m map<string,string>")
    card = df.select(text.display_document(F.col("d"), F.col("m")).alias("c")).first()["c"]
    assert card["title"] == title


JSONS = ['["a","b"]', '["a"] extra', "1] foo", "[1],[2]", '["a",1]', "[]", "null", '"str"', "", " ", "tru",
         '{"a": {"b": 1}}', '{"a":1', "1 2", '"a', "01", "-1.5e3", '\n[1]\n', "[1,]", "{}", "'a'"]


def loads(value):
    try:
        json.loads(value)
        return True
    except ValueError:
        return False


def test_strict_json_accepts_what_a_strict_parser_does(spark):
    assert each(spark, JSONS, jsonio.is_valid_json) == [loads(v) for v in JSONS]


def test_json_taken_as_invalid_on_purpose(spark):
    assert each(spark, ["NaN", "[NaN]", '{"a":1,"a":2}'], jsonio.is_valid_json) == [False] * 3


def test_coerce_parts(spark):
    df = spark.sql("select array(named_struct('text','a','n',1), named_struct('text',cast(null as string),'n',2)) p")
    assert df.select(jsonio.coerce_parts(F.col("p")).alias("r")).first()["r"] == 'a\n{"n":2}'
    assert one(spark, None, jsonio.coerce_text) == ""


def test_cache_key_matches_plain_hash(spark):
    import hashlib
    df = spark.createDataFrame([("p", "s", "m", ["a", 'b"'])], "p string, s string, m string, k array<string>")
    got = df.select(prompts.cache_key("p" and F.col("p"), F.col("s"), F.col("m")).alias("plain"),
                    prompts.cache_key(F.col("p"), F.col("s"), F.col("m"), F.col("k")).alias("keys")).first()
    digest = lambda keys: hashlib.sha256(f"p|s|m|{json.dumps(keys)}".encode()).hexdigest()
    assert got["plain"] == digest([])
    assert got["keys"] == digest(["a", 'b"'])


def test_chunk_prompt(spark):
    df = spark.createDataFrame([("q", 2, ["one", "two %s"])], "q string, i int, d array<string>")
    got = df.select(prompts.chunk_prompt(F.col("q"), F.col("i"), F.col("d")).alias("r")).first()["r"]
    assert got == ("User query: q\n\nResearch documents (chunk 2):\n--- Document 1 ---\none\n\n--- Document 2 ---\n"
                   "two %s\n\n\nPlease provide a comprehensive answer grounded in these documents.")


def test_schema_hint_and_defaults(spark):
    df = spark.createDataFrame([(["a", "b"], [], "", "m")], "k array<string>, e array<string>, x string, y string")
    got = df.select(prompts.with_schema_hint(F.lit("Do."), F.col("k")).alias("a"),
                    prompts.with_schema_hint(F.lit("Do."), F.col("e")).alias("b"),
                    prompts.first_set(F.col("x"), F.col("y"), F.lit("z")).alias("c")).first()
    assert got["a"] == "Do.\n\nRespond with a JSON object containing these keys: a, b."
    assert (got["b"], got["c"]) == ("Do.", "m")


def test_category_list_has_all_lines():
    lines = prompts.category_list().split("\n")
    assert len(lines) == 19 and lines[0] == "  cs.LG: Machine Learning"


def test_score_arithmetic(spark):
    assert one(spark, 1.0, scores.dense_score, "double") == 0.5
    assert one(spark, None, scores.dense_score, "double") == 0.0
    assert one(spark, 0.0125, scores.elapsed_ms, "double") == 12
    assert one(spark, 2.35, scores.elapsed_seconds, "double") == pytest.approx(2.4)


def test_missing_response_gives_error_text(spark):
    assert one(spark, None, lambda c: prompts.response_or_error(c, F.lit(3))) == "[Error generating response for chunk 3]"

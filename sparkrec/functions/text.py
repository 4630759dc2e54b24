"""Text columns: cleaning, stripping, terms and display formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sparkrec import constants as K
from sparkrec.functions.arrays import let
from sparkrec.functions.jsonio import strict_json

# The two sets of blanks differ in a few control characters.
PY_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
JS_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def strip(c: Column) -> Column:
    """Remove Unicode blanks at both ends (plain `trim` takes off the space only)."""
    return F.trim(c, F.lit(PY_SPACE))


def strip_client(c: Column) -> Column:
    """The browser's notion of blanks, used on event frames and typed prompts."""
    return F.trim(c, F.lit(JS_SPACE))


def clean_newlines(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(" "))


def strip_fences(c: Column) -> Column:
    out = strip(c)
    for fence in K.CODE_FENCES:
        out = F.replace(out, F.lit(fence), F.lit(""))
    return strip(out)


def terms(c: Column) -> Column:
    """Distinct lower-case words: runs of letters, numbers and underscore."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    )


def percent(c: Column) -> Column:
    whole = F.floor(c * 100 + F.lit(0.5)).cast("long").cast("string")
    return F.coalesce(F.concat(whole, F.lit("%")), F.lit(K.MISSING_PERCENT))


def score_band(c: Column) -> Column:
    return (
        F.when(c.isNull(), "muted").when(c >= 0.7, "high").when(c >= 0.4, "mid").otherwise("low")
    )


def display_document(document: Column, meta: Column) -> Column:
    """Card fields: a JSON document with a title as is, plain text cut to size."""
    def card(value: Column) -> Column:
        # A scalar or list has no fields, so every path below is null for it.
        title = F.try_variant_get(value, "$.title", "variant")
        kind = F.schema_of_variant(title)
        shown = F.try_variant_get(value, "$.title", "string")
        # JavaScript truth: empty text, zero, false and null do not count as a title.
        truthy = (
            F.when(kind == "STRING", F.length(shown) > 0)
            .when(kind == "BOOLEAN", F.try_variant_get(value, "$.title", "boolean"))
            .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"),
                  F.try_variant_get(value, "$.title", "double") != 0)
            .otherwise(F.coalesce(kind != "VOID", F.lit(False)))
        )
        fields = F.struct(
            shown.alias("title"),
            *[F.try_variant_get(value, f"$.{k}", "string").alias(k)
              for k in ("category", "summary", "authors")],
        )
        return F.when(truthy, fields)

    plain = F.struct(
        F.substring(document, 1, 120).alias("title"),
        F.coalesce(meta["categories"], F.lit("")).alias("category"),
        F.substring(document, 1, 300).alias("summary"),
        F.coalesce(meta["authors_parsed"], F.lit("")).alias("authors"),
    )
    return F.coalesce(let(strict_json(document), card), plain)

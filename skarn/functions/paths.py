"""API path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A path announced by a method, a versioned path, and the narrower form used for grounding.
METHOD_PATH = r"\b(?:GET|POST|PUT|PATCH|DELETE)\b\s*[`'\"]?\s*(/[\w{}\-./]+)"
METHOD_AND_PATH = r"\b(GET|POST|PUT|PATCH|DELETE)\b\s*[`'\"]?\s*/[\w{}\-./]+"
VERSIONED_PATH = r"/[\w{}\-.]+/v\d+/[\w{}\-./]*"
GROUNDING_PATH = r"/[a-zA-Z][\w-]*/v\d+/[\w{}/\-.]*"


def normalise(path: Column) -> Column:
    """Without closing punctuation and slashes, placeholders as {}, lower case."""
    bare = F.regexp_replace(F.regexp_replace(path, "[.,;:)'\"`]+$", ""), "/+$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"\{\{[^}]*\}\}", "{}"), r"\{[^}]*\}", "{}"))


def extract(text: Column) -> Column:
    """Distinct normalised paths in order of appearance: those after a method first, then versioned ones."""
    source = F.coalesce(text, F.lit(""))
    found = F.concat(F.regexp_extract_all(source, F.lit(METHOD_PATH), 1), F.regexp_extract_all(source, F.lit(VERSIONED_PATH), 0))
    real = F.filter(
        F.transform(found, normalise), lambda p: (F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit(""))) >= 2) & p.rlike("[a-z]")
    )
    return F.array_distinct(real)


def versioned(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(VERSIONED_PATH), 0), normalise))


def gold(text: Column) -> Column:
    return F.filter(extract(text), lambda p: F.contains(p, F.lit("/v")))


def grounding(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(GROUNDING_PATH), 0)
    return F.array_distinct(F.transform(found, lambda p: F.regexp_replace(p, "[.,;:)]+$", "")))


def url_parts(url: Column) -> Column:
    """A request's URL struct <raw, path array, query array<struct<key,value,disabled>>> as (path, enabled query)."""
    path = F.when(url["path"].isNull(), F.coalesce(url["raw"], F.lit(""))).otherwise(F.concat(F.lit("/"), F.array_join(url["path"], "/")))
    query = F.filter(F.coalesce(url["query"], F.array()), lambda q: ~F.coalesce(q["disabled"], F.lit(False)))
    return F.struct(path.alias("path"), query.alias("query"))

"""Text expressions as Columns, so Catalyst sees through them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METHODS = "GET|POST|PUT|PATCH|DELETE"
#: The patterns by which identifiers, sections and claims are recognised.
TOKEN = "[A-Za-z0-9_]+"
CAMEL_PIECE = "[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])"
SUBQUERY_BREAK = r"\band then\b|\bthen\b|\bafter that\b|[;\n]|\d\.\s"
OPERATION_ID = r"\b[a-z][A-Za-z0-9]{6,}\b"
OPERATION_VERB = "^(get|post|put|patch|delete|create|update|fetch|list)[A-Z]"
CAPITALISED_PHRASE = r"\b[A-Z][A-Za-z\-]+(?: [A-Z][A-Za-z\-]+){1,4}\b"


#: White space of any script, as Python's str.strip sees it.
SPACE = r"[\s\p{Z}\x85\x1c-\x1f\x0b]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def strip_html(c: Column) -> Column:
    return strip(F.regexp_replace(c, "<[^>]+>", " "))


def clean_text(c: Column) -> Column:
    """At most one blank line in a row, single spaces, no lines of one to three characters unless they start with a letter."""
    spaced = F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), "[ \t]+", " ")

    def kept(line: Column) -> Column:
        bare = strip(line)
        return ~(F.length(bare).between(1, 3) & ~bare.rlike(r"^\p{L}"))

    return strip(F.array_join(F.filter(F.split(spaced, "\n"), kept), "\n"))


def truncate(c: Column, size: int = 2000, mark: str = "\n... (truncated)") -> Column:
    bare = strip(c)
    return F.when(F.length(bare) <= size, bare).otherwise(F.concat(F.substring(bare, 1, size), F.lit(mark)))


def tokens(c: Column) -> Column:
    """Lower-case identifiers followed by their camel-case pieces of two or more characters."""
    whole = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), 0)

    def with_pieces(t: Column) -> Column:
        pieces = F.filter(F.regexp_extract_all(t, F.lit(CAMEL_PIECE), 0), lambda p: F.length(p) > 1)
        return F.concat(F.array(F.lower(t)), F.transform(pieces, F.lower))

    return F.flatten(F.transform(whole, with_pieces))


def gold_words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]{5,}"), 0))


def coverage(words: Column, context: Column) -> Column:
    """Share of the words that are substrings of the lower-case context; 0 without words."""
    low = F.lower(context)
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(low, w))) / F.size(words)).otherwise(F.lit(0.0))


def subqueries(question: Column, least: int = 25, most: int = 4, distinct: bool = False) -> Column:
    """The question, then its parts of more than ``least`` characters, ``most`` in all. A question that does not split
    comes twice unless ``distinct``."""
    parts = F.filter(F.transform(F.split(question, SUBQUERY_BREAK), strip), lambda p: F.length(p) > least)
    every = F.concat(F.array(question), parts)
    return F.slice(F.array_distinct(every) if distinct else every, 1, most)


def action_phrase(summary: Column, description: Column) -> Column:
    first = F.split(strip(F.coalesce(description, F.lit(""))), r"\.")[0]
    chosen = F.when(strip(F.coalesce(summary, F.lit(""))) != "", strip(summary)).otherwise(first)
    one_line = F.regexp_replace(chosen, r"\s+", " ")
    lowered = F.concat(F.lower(F.substring(one_line, 1, 1)), F.substring(one_line, 2, 1 << 30))
    return F.regexp_replace(lowered, r"\.+$", "")


def short_digest(c: Column, size: int = 12, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(c), 1, size))


def hash_order(seed: int, *columns: Column) -> Column:
    """A digest to order by in place of random numbers; the same in any engine that has MD5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))


def default_text(c: Column, value: str = "") -> Column:
    return F.coalesce(c, F.lit(value))

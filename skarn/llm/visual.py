"""Problem 9: visually identical text with different characters.

Method: DuckDB inside Arrow partitions. Every Arrow batch is registered in an in-process database and rewritten by one
SQL expression of ``translate`` (look-alikes, full-width forms, spaces), ``regexp_replace`` (line ends, invisible
characters, ligatures) and ``nfc_normalize`` (accents). No row leaves its task; the pair search then shuffles two 16-byte
digests a row. Different strings of a class are paired first, members come back by salted joins, so equal strings cost
nothing but the pairs that are asked for.

Defined results. Null text: canonical form null, never in a pair. Empty text: form ''. A text of invisible characters
only: form '', which looks the same as the empty text. Repeated rows and equal strings: no pair among themselves, each
pairs with every differing string of its class. Empty table: empty result. Raised, built-up and accented characters
keep their difference. Extra columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.chars import REPLACEMENTS
from skarn.plans.shared import materialize
from skarn.plans.skew import salted_join
from skarn.plans.spread import spread

#: Strings of one class that a pair task holds on each side.
BLOCK_STRINGS = 2_000
#: Bytes of text that DuckDB gets at once.
BATCH_BYTES = 16_000_000


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class(characters: str) -> str:
    """A regular expression for one or more of the characters, neighbours as ranges."""
    points = sorted(map(ord, characters))
    ranges: list[list[int]] = []
    for p in points:
        if ranges and p == ranges[-1][1] + 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in ranges) + "]+"


def canonical_sql(column: str) -> str:
    """SQL for the visible form of ``column``."""
    kept = {a: b for a, b in REPLACEMENTS.items() if len(b) == 1}
    nothing = "".join(a for a, b in REPLACEMENTS.items() if not b)
    mapped = f"translate({column}, {_quoted(''.join(kept))}, {_quoted(''.join(kept.values()))})"
    mapped = f"regexp_replace({mapped}, {_quoted(_class(nothing))}, '', 'g')"
    for ligature, letters in REPLACEMENTS.items():
        if len(letters) > 1:
            mapped = f"replace({mapped}, {_quoted(ligature)}, {_quoted(letters)})"
    mapped = f"nfc_normalize({mapped})"
    ends = r"regexp_replace({0}, '\r\n?', chr(10), 'g')"
    return (
        f"CASE WHEN strlen({column}) = length({column}) AND NOT contains({column}, chr(13)) THEN {column} "
        f"ELSE {ends.format(mapped)} END"
    )


def _bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of at most ``BATCH_BYTES`` of text, or one longer row."""
    sizes = [n or 0 for n in pc.binary_length(batch.column(1)).to_pylist()]
    first, held = 0, 0
    for row, size in enumerate(sizes):
        if row > first and held + size > BATCH_BYTES:
            yield batch.slice(first, row - first)
            first, held = row, 0
        held += size
    if first < batch.num_rows or not batch.num_rows:
        yield batch.slice(first)


def _run(sql: str):
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        for batch in batches:
            for part in _bounded(batch):
                con.register("batch", pa.Table.from_batches([part]))
                result = con.sql(sql).to_arrow_table()
                con.unregister("batch")
                yield from result.to_batches()
        con.close()

    return rewrite


def canonical_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) -> (id, canonical_text, changed)."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sql = f"SELECT id, c AS canonical_text, c <> text AS changed FROM (SELECT id, text, {canonical_sql('text')} AS c FROM batch)"
    out = rows.mapInArrow(_run(sql), "id long, canonical_text string, changed boolean")
    return out.withColumnRenamed("id", id_col)


def visual_digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, look, raw): 128-bit digests of the visible form and of the string itself."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    sql = f"SELECT id, unhex(md5({canonical_sql('text')})) AS look, unhex(md5(text)) AS raw FROM batch"
    return spread(rows).mapInArrow(_run(sql), "id long, look binary, raw binary")


def visual_strings(digests: DataFrame) -> DataFrame:
    """The different strings of classes that have two or more: (look, raw, strings), strings their number in the class.

    Equal strings are merged before the shuffle, so a third of all rows being one string costs a row a task.
    """
    strings = digests.select("look", "raw").distinct()
    classes = strings.groupBy("look").agg(F.count("*").alias("strings")).where(F.col("strings") > 1)
    return strings.join(classes, "look")


def visual_pairs(digests: DataFrame, block_strings: int = BLOCK_STRINGS) -> DataFrame:
    """All pairs of documents that look the same and are not the same string, as (doc_id_a, doc_id_b), a < b.

    Pairs of strings first: in a large class one side is dealt over ``strings / block_strings`` blocks, the other is
    repeated for each. Then the members of each string, by two joins that salt strings of many members.
    """
    strings = materialize(visual_strings(digests), "p9-strings")
    blocks = F.ceil(F.col("strings") / block_strings).cast("int")
    left = strings.select("look", F.col("raw").alias("raw_a"), F.pmod(F.xxhash64("raw"), blocks).cast("int").alias("block"))
    right = strings.select("look", F.col("raw").alias("raw_b"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    pairs = left.join(right, ["look", "block"]).where(F.col("raw_a") < F.col("raw_b")).select("raw_a", "raw_b")
    members = materialize(salted_join(digests.select("id", "raw"), strings.select("raw"), "raw", "left_semi", "id"), "p9-members")
    one = members.select(F.col("id").alias("id_a"), F.col("raw").alias("raw_a"))
    two = members.select(F.col("id").alias("id_b"), F.col("raw").alias("raw_b"))
    half = salted_join(one, pairs, "raw_a", "inner", "id_a").select("id_a", "raw_b")
    both = salted_join(two, half, "raw_b", "inner", "id_b").where("id_a <> id_b")
    return both.select(F.least("id_a", "id_b").alias("doc_id_a"), F.greatest("id_a", "id_b").alias("doc_id_b"))

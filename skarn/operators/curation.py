"""Benchmarks: merging, stratified splits and samples, path audits, claim checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.functions import paths, text
from skarn.functions.text import hash_order
from skarn.plans.shared import materialize
from skarn.plans.spread import spread

SEED = 42


def merge_new(existing: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Existing rows and the first new row of each key that does not exist."""
    fresh = new.join(existing.select(key).distinct(), key, "left_anti")
    first = fresh.groupBy(key).agg(F.min_by(F.struct(*new.columns), F.struct(*order)).alias("_r")).select("_r.*")
    return existing.unionByName(first)


#: Ranges of the digest that are counted before rows are ranked.
PREFIX = 4


def mark_lowest(df: DataFrame, strata: list[str], key: str, quota: Callable[[Column], Column], seed: int = SEED, name: str = "chosen") -> DataFrame:
    """Mark the ``quota(n)`` rows of each stratum with the smallest digests of ``key`` (ties by key); n is its size.

    Rows are counted by stratum and digest prefix; only the one range in which the quota ends is ranked, so a stratum
    that holds a third of all rows is still spread over all ranges.
    """
    digest = hash_order(seed, F.col(key).cast("string"))
    rows = df.withColumns({"_h": digest, "_p": F.substring(digest, 1, PREFIX), "_s": F.to_json(F.struct(*strata)) if strata else F.lit("")})
    counts = rows.groupBy("_s", "_p").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_s").orderBy("_p"))
    sizes = counts.withColumns({"_before": upto - F.col("_c"), "_n": F.sum("_c").over(Window.partitionBy("_s"))})
    left = sizes.select("_s", "_p", (quota(F.col("_n")).cast("long") - F.col("_before")).alias("_left"))
    ranked = rows.join(left, ["_s", "_p"]).withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_p").orderBy("_h", key)))
    return ranked.withColumn(name, F.col("_r") <= F.col("_left")).drop("_h", "_p", "_s", "_left", "_r")


def stratified_split(df: DataFrame, strata: list[str], key: str, share: float = 0.3, seed: int = SEED) -> DataFrame:
    """Test gets max(1, round-half-even(share * n)) rows of each stratum."""
    test = mark_lowest(df, strata, key, lambda n: F.greatest(F.lit(1), F.bround(n * F.lit(share), 0)), seed)
    return test.withColumn("subset", F.when(F.col("chosen"), "test").otherwise("dev")).drop("chosen")


def stratified_sample(df: DataFrame, strata: list[str], key: str, n: int, up: bool = False, seed: int = SEED) -> DataFrame:
    """n divided by the number of strata from each stratum, rounded down (at least 1) or up, n in all at most.

    Each task keeps its own best of a stratum before the shuffle (a limit by rank), so a hot stratum costs little.
    """
    groups = df.select(*strata).distinct().count()
    per = -(-n // max(1, groups)) if up else max(1, n // max(1, groups))
    digest = hash_order(seed, F.col(key).cast("string"))
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(digest, F.col(key)))
    chosen = df.withColumn("_place", place).where(F.col("_place") <= per).drop("_place")
    return chosen.orderBy(*strata, digest, key).limit(n) if up else chosen


def train_val_split(df: DataFrame, key: str, share: float = 0.05, seed: int = SEED) -> DataFrame:
    """Validation gets the max(1, floor(share * n)) rows with the smallest digests."""
    val = mark_lowest(df, [], key, lambda n: F.greatest(F.lit(1), F.floor(n * F.lit(share))), seed)
    return val.withColumn("subset", F.when(F.col("chosen"), "val").otherwise("train")).drop("chosen")


def round_robin(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """One row of each group in turn, until n."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", group, *order).limit(n)


def upweight(df: DataFrame, column: str, weights: dict[str, int]) -> DataFrame:
    """Each row as often as its category weighs, once by default."""
    weight: Column = F.lit(1)
    for name, w in weights.items():
        weight = F.when(F.col(column) == name, w).otherwise(weight)
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(1), weight)))


def valid_paths(corpus: DataFrame) -> DataFrame:
    """Distinct normalised paths: those in the metadata and the versioned ones in the text."""
    stated = corpus.where("path IS NOT NULL AND path <> ''").select(paths.normalise(F.col("path")).alias("path"))
    written = corpus.select(F.explode(paths.versioned(F.col("text"))).alias("path"))
    return stated.union(written).distinct()


def path_methods(corpus: DataFrame) -> DataFrame:
    """Methods attested for each path; paths known from text only have none."""
    stated = corpus.where("path IS NOT NULL AND path <> ''").select(paths.normalise(F.col("path")).alias("path"), F.upper("method").alias("method"))
    written = corpus.select(F.explode(paths.versioned(F.col("text"))).alias("path"), F.lit(None).cast("string").alias("method"))
    return stated.unionByName(written).groupBy("path").agg(F.array_sort(F.collect_set("method")).alias("methods"))


def cited_paths(answers: DataFrame, key: str, text_col: str, carry: list[str]) -> DataFrame:
    return answers.select(key, *carry, F.explode(paths.extract(F.col(text_col))).alias("path"))


def hallucination_rate(answers: DataFrame, valid: DataFrame, group: str, key: str, text_col: str) -> DataFrame:
    """Per group of judged answers: answers with paths, answers with an invalid path, paths and invalid paths, and both shares in percent."""
    cited = cited_paths(answers, key, text_col, [group])
    judged = cited.join(valid.select("path", F.lit(True).alias("ok")), "path", "left").select(group, key, F.coalesce("ok", F.lit(False)).alias("ok"))
    per_answer = judged.groupBy(group, key).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("bad"))
    totals = per_answer.groupBy(group).agg(
        F.count("*").alias("answers_with_paths"), F.count_if(F.col("bad") > 0).alias("answers_with_bad"), F.sum("n").alias("total_paths"), F.sum("bad").alias("bad_paths")
    )
    return totals.withColumns(
        {
            "answers_bad_pct": F.round(F.try_divide(100.0 * F.col("answers_with_bad"), F.col("answers_with_paths")), 6),
            "bad_path_pct": F.round(F.try_divide(100.0 * F.col("bad_paths"), F.col("total_paths")), 6),
        }
    )


def audit_paths(tasks: DataFrame, valid: DataFrame, key: str, text_col: str) -> DataFrame:
    """Cited, verified and missing versioned paths of each task that cites any."""
    cited = cited_paths(tasks, key, text_col, []).where(F.contains("path", F.lit("/v")))
    judged = cited.join(valid.select("path", F.lit(1).alias("ok")), "path", "left")
    return judged.groupBy(key).agg(F.count("*").alias("cited"), F.count("ok").alias("verified"), F.count_if(F.col("ok").isNull()).alias("missing"))


def audit_totals(audited: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row: tasks, tasks that cite paths, those with a missing one, paths cited, verified and missing."""
    return (
        tasks.agg(F.count("*").alias("tasks"))
        .crossJoin(  # one row each
            audited.agg(
                F.count("*").alias("tasks_with_paths"), F.count_if(F.col("missing") > 0).alias("tasks_with_missing"), F.coalesce(F.sum("cited"), F.lit(0)).alias("cited"),
                F.coalesce(F.sum("verified"), F.lit(0)).alias("verified"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"),
            )
        )
    )


#: Phrases of one automaton. More are looked up in further passes over the texts, so a task's memory is bounded.
BLOCK_PHRASES = 100_000


def _holds(phrases: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for n, phrase in enumerate(phrases):
            automaton.add_word(phrase, n)
        automaton.make_automaton()
        seen: set[int] = set()
        for batch in batches:
            fresh = {n for t in batch.column(0).to_pylist() if t for _, n in automaton.iter(t)} - seen
            seen |= fresh
            yield pa.RecordBatch.from_arrays([pa.array([phrases[n] for n in sorted(fresh)], pa.string())], names=["phrase"])

    return scan


def contained(phrases: DataFrame, texts: DataFrame, block_phrases: int = BLOCK_PHRASES) -> DataFrame:
    """The phrases (phrase) that stand anywhere in a text of the first column of ``texts``; both in lower case.

    One map-only pass over the texts for each block of distinct phrases; no text is shuffled.
    """
    asked = materialize(phrases.select("phrase").where("phrase <> ''").distinct(), "asked-phrases")
    blocks = -(-asked.count() // block_phrases)
    found = asked.limit(0)
    if not blocks:
        return found
    searched = spread(texts.select(F.col(texts.columns[0]).alias("text")))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("phrase"), F.lit(blocks)))
    for block in range(blocks):
        if rows := [r.phrase for r in numbered.where(F.col("block") == block).orderBy("phrase").toLocalIterator()]:
            found = found.unionByName(searched.mapInArrow(_holds(rows), "phrase string"))
    return found.distinct()


def verify_claims(tasks: DataFrame, methods: DataFrame, texts: DataFrame, operations: DataFrame, suppress_bare: bool = False) -> DataFrame:
    """Findings of each task joined by " | " and a verdict, CLEAN or CHECK.

    ``tasks``: (id, category, expected_answer); ``methods``: (path, methods); ``texts``: every text of the corpus, lower
    case, in its first column; ``operations``: known operation ids, lower case (operation). A capitalised phrase is
    attested if any text contains it. ``suppress_bare``: any finding on a path with a method hides those on bare paths of
    that task.
    """
    answer = F.col("expected_answer")
    calls = F.arrays_zip(
        F.regexp_extract_all(answer, F.lit(paths.METHOD_AND_PATH), 1).alias("method"), F.regexp_extract_all(answer, F.lit(paths.METHOD_PATH), 1).alias("raw")
    )
    called = tasks.select("id", F.explode(calls).alias("c")).select("id", "c.method", "c.raw", paths.normalise(F.col("c.raw")).alias("path"))
    called = called.groupBy("id", "method", "path").agg(F.min("raw").alias("raw"))
    known = called.join(methods, "path", "left")
    on_calls = known.select(
        "id",
        F.when(F.col("methods").isNull(), F.concat(F.lit("PATH NOT IN CORPUS: "), "method", F.lit(" "), "raw")).when(
            (F.size("methods") > 0) & ~F.array_contains("methods", F.col("method")),
            F.concat(F.lit("METHOD MISMATCH: reference says "), "method", F.lit(" "), "raw", F.lit("; corpus has "), F.array_join("methods", "/")),
        ).alias("note"),
    ).where("note IS NOT NULL")
    bare = tasks.select("id", F.explode(paths.gold(answer)).alias("path")).join(methods.select("path"), "path", "left_anti")
    bare = bare.join(called.select("id", "path").distinct(), ["id", "path"], "left_anti")  # those are judged with their method
    on_bare = bare.select("id", F.concat(F.lit("PATH NOT IN CORPUS: "), "path").alias("note"))
    if suppress_bare:
        on_bare = on_bare.join(on_calls.where("note LIKE 'PATH NOT%'").select("id").distinct(), "id", "left_anti")
    named = tasks.select("id", F.explode(F.array_distinct(F.regexp_extract_all(answer, F.lit(text.OPERATION_ID), 0))).alias("op")).where(
        F.col("op").rlike(text.OPERATION_VERB)
    )
    on_operations = named.join(operations, F.lower("op") == F.col("operation"), "left_anti").select(
        "id", F.concat(F.lit("OPERATION ID NOT IN CORPUS: "), "op").alias("note")
    )
    said = tasks.where("category = 'config_advisory'").select(
        "id", F.explode(F.array_distinct(F.regexp_extract_all(answer, F.lit(text.CAPITALISED_PHRASE), 0))).alias("p")
    )
    said = said.withColumn("phrase", F.lower("p"))
    on_phrases = said.join(contained(said, texts), "phrase", "left_anti").select(
        "id", F.concat(F.lit("CONTROL/SETTING NOT FOUND IN DOCS: '"), "p", F.lit("'")).alias("note")
    )
    notes = on_calls.unionByName(on_bare).unionByName(on_operations).unionByName(on_phrases)
    joined = notes.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("note")), " | ").alias("findings"))
    return tasks.select("id").join(joined, "id", "left").select(
        "id", F.when(F.col("findings").isNull(), "CLEAN").otherwise("CHECK").alias("verdict"), F.coalesce("findings", F.lit("")).alias("findings")
    )

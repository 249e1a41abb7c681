"""The pN_ queries, each over its whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import balanced, crosssplit, defects, groups, leakage, packing, pieces, truncation, visual
from skarn.plans.shared import materialize, ship
from skarn.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target with rows needed, available and drawn, and the residual imbalance of the drawn sample."""
    ship(spark)
    rows = table(spark, sf_dir, "benchmark_seed")
    report = materialize(balanced.targets_report(rows, table(spark, sf_dir, "sample_targets")), "p1-report")
    return balanced.sample_report(materialize(balanced.balanced_sample(rows, report), "p1-sample"), report)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that the drawn sample cannot meet."""
    return p1_report(spark, sf_dir).where(~F.col("met")).select("module", "category", "difficulty")


def p1_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows needed and drawn by single label."""
    return balanced.margin_report(p1_report(spark, sf_dir))


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = table(spark, sf_dir, "benchmark_seed")
    report = materialize(balanced.targets_report(rows, table(spark, sf_dir, "sample_targets")), "p1-report")
    return balanced.balanced_sample(rows, report)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    requests = table(spark, sf_dir, "all_postman_chunks").select(
        F.lit("all_postman_chunks").alias("table_name"), F.col("row_no").alias("row_key"), F.col("source_file").alias("source"),
        "path", none.alias("question"), "text",
    )
    answers = table(spark, sf_dir, "eval_results").select(
        F.lit("eval_results").alias("table_name"), F.col("result_id").alias("row_key"), F.col("config").alias("source"),
        none.alias("path"), "question", F.col("generated_answer").alias("text"),
    )
    return requests.unionByName(answers)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return truncation.cut_texts(_texts(spark, sf_dir)).where("cut").select("table_name", "row_key")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut rows per source file and per configuration."""
    ship(spark)
    return truncation.cut_share(truncation.cut_texts(_texts(spark, sf_dir)))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "sft_train").select(F.col("example_id").alias("record_id"), groups.message_keys().alias("keys"))
    tasks = table(spark, sf_dir, "benchmark_seed").select(F.col("id").alias("record_id"), groups.task_keys().alias("keys"))
    none = F.array().cast("array<string>")
    return chats.unionByName(tasks).where("record_id IS NOT NULL").withColumn("keys", F.coalesce("keys", none))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.record_groups(_records(spark, sf_dir)).where("members > 1").select("record_id", "group_id")


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its group and its split."""
    return groups.assign_splits(materialize(groups.record_groups(_records(spark, sf_dir)), "p3-groups"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return defects.defective_pairs(table(spark, sf_dir, "eval_results"))


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return crosssplit.cross_split_overlaps(table(spark, sf_dir, "benchmark_seed"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _overlaps(spark, sf_dir)
    return pairs.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation split and source."""
    return crosssplit.overlap_report(materialize(_overlaps(spark, sf_dir), "p5-pairs"), table(spark, sf_dir, "benchmark_seed"))


LIMITS = {"all_doc_chunks": 4_000, "all_postman_chunks": 6_000}


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all texts of both tables."""
    ship(spark)
    return pieces.split_pieces({name: table(spark, sf_dir, name) for name in LIMITS}, LIMITS)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.oversized(p6_pieces(spark, sf_dir))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or piece of one larger than a container, with its container."""
    ship(spark)
    return packing.pack(packing.token_counts(table(spark, sf_dir, "documents")))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(p7_containers(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_overlaps(spark, sf_dir).select("doc_id", "item_id")


def p8_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items with how many words of them each document holds."""
    ship(spark)
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    digests = materialize(visual.visual_digests(table(spark, sf_dir, "documents"), "doc_id", "text"), "p9")
    return visual.visual_pairs(digests)


def p9_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its one form."""
    ship(spark)
    return visual.canonical_text(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_report, p1_margins, p1_sample, p2_found, p2_report, p3_found, p3_splits, p4_found, p5_found, p5_report, p6_found, p6_pieces, p7_containers, p7_report, p8_found)
    + (p8_overlaps, p9_found, p9_canonical)
}

_CANONICAL = "regexp_replace(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '[\\s_-]+', '_', 'g')"

_NEED = "greatest(min_rows, (target_per_10000::BIGINT * draw + 9999) // 10000)::BIGINT"
_LABELS = f"""
        WITH rows AS (
            SELECT {_CANONICAL.format("module")} AS m, {_CANONICAL.format("category")} AS c, {_CANONICAL.format("difficulty")} AS d
            FROM benchmark_seed
        ), counted AS (SELECT m, c, d, count(*) AS n FROM rows GROUP BY ALL),
        size AS (SELECT count(*) // 5 AS draw FROM benchmark_seed),
        t AS (SELECT module, category, difficulty, target_per_10000, min_rows, {_NEED} AS needed, coalesce(n, 0) AS available
              FROM sample_targets CROSS JOIN size LEFT JOIN counted
              ON m = {_CANONICAL.format("module")} AND c = {_CANONICAL.format("category")} AND d = {_CANONICAL.format("difficulty")})"""
_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"


def _counted(name: str, column: str) -> str:
    """CTEs: words of a column with their counts, and the number of words, by record."""
    return f"""{name} AS (SELECT id, split, w, count(*) AS c FROM (SELECT id, split, unnest({_WORDS.format(visual.canonical_sql(column))}) AS w FROM b) GROUP BY ALL),
        {name}n AS (SELECT id, split, sum(c) AS n FROM {name} GROUP BY ALL)"""


def _alike(name: str) -> str:
    return f"""(SELECT x.id AS t, y.id AS e FROM {name} x JOIN {name} y ON x.w = y.w AND x.split = 'train' AND y.split IN ('dev', 'test')
        JOIN {name}n xn ON xn.id = x.id JOIN {name}n yn ON yn.id = y.id GROUP BY x.id, y.id, xn.n, yn.n HAVING sum(least(x.c, y.c)) >= {crosssplit.SAME_WORDS} * greatest(xn.n, yn.n))"""


_SAID = """list_transform(list_filter(messages, lambda x: coalesce(x.role, '') <> 'system' AND x.content IS NOT NULL), lambda x:
            CASE WHEN starts_with(x.content, 'Context:') AND contains(x.content, chr(10) || chr(10) || 'Question:')
                 THEN regexp_replace(x.content, '(?s)\\AContext:.*?\\n\\nQuestion:', ' ') ELSE x.content END)"""
_TASK_SQL = "'b:' || lower(regexp_extract({0}, '{1}', 1)) || '-' || lower(regexp_extract({0}, '{1}', 2)) || '-' || regexp_extract({0}, '{1}', 3)::BIGINT"

SQL: dict[str, str] = {
    "p1_report": _LABELS
    + " SELECT *, least(needed, available) AS drawn, least(needed, available) - needed AS residual, available >= needed AS met FROM t",
    "p1_margins": _LABELS
    + """, l AS (SELECT unnest(['module', 'category', 'difficulty']) AS label, unnest([module, category, difficulty]) AS value, needed, least(needed, available) AS drawn FROM t)
        SELECT label, value, sum(needed)::BIGINT AS needed, sum(drawn)::BIGINT AS drawn, (sum(drawn) - sum(needed))::BIGINT AS residual FROM l GROUP BY ALL""",
    "p3_found": f"""
        WITH RECURSIVE m AS (SELECT example_id AS record_id, array_to_string({_SAID}, chr(10)) AS t FROM sft_train),
        k AS (
            SELECT record_id, 'p:' || regexp_replace(regexp_replace(lower(p), '[^a-z0-9]', '', 'g'), '([a-z])0+([0-9])', '\\1\\2') AS key FROM (
                SELECT record_id, unnest(list_concat(regexp_extract_all(t, '{groups.ASKED}', 1), regexp_extract_all(t, '{groups.WROTE}', 1))) AS p FROM m)
            UNION SELECT record_id, 't:' || x::BIGINT FROM (SELECT record_id, unnest(regexp_extract_all(t, '{groups.TICKET}', 1)) AS x FROM m)
            UNION SELECT record_id, {_TASK_SQL.format("x", groups.TASK)} FROM (SELECT record_id, unnest(regexp_extract_all(t, '{groups.TASK}')) AS x FROM m)
            UNION SELECT id, {_TASK_SQL.format("id", groups.TASK)} FROM benchmark_seed),
        e AS (SELECT DISTINCT a.record_id AS a, b.record_id AS b FROM k a JOIN k b USING (key)),
        r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT a AS record_id, min(b) AS group_id FROM r GROUP BY a HAVING count(DISTINCT b) > 1
    """,
    "p5_found": f"""
        WITH b AS (SELECT id, split, question, expected_answer FROM benchmark_seed), {_counted("q", "question")}, {_counted("a", "expected_answer")}
        SELECT least(t, e) AS id_a, greatest(t, e) AS id_b FROM {_alike("q")} JOIN {_alike("a")} USING (t, e)
    """,
    "p9_canonical": f"SELECT doc_id, c AS canonical_text, c <> text AS changed FROM (SELECT doc_id, text, {visual.canonical_sql('text')} AS c FROM documents)",
    "p9_found": f"""
        WITH v AS (SELECT doc_id, text, {visual.canonical_sql("text")} AS c FROM documents)
        SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM v a JOIN v b ON a.c = b.c AND a.doc_id < b.doc_id AND a.text <> b.text
    """,
    "p1_found": _LABELS + " SELECT module, category, difficulty FROM t WHERE available < needed",
    "p6_found": """
        WITH texts AS (
            SELECT 'all_doc_chunks' AS table_name, row_no, text, 4000 AS size FROM all_doc_chunks
            UNION ALL SELECT 'all_postman_chunks', row_no, text, 6000 FROM all_postman_chunks
        )
        SELECT table_name, row_no,
               CASE WHEN list_max(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: length(w))) > size
                    THEN 'forced' ELSE 'boundary' END AS kind
        FROM texts WHERE length(text) > size
    """,
}

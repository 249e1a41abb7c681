"""Queries for the reference's operators, each over its whole tables, beside the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import paths, text, vectors
from skarn.operators import corpus, curation, evaluation, ingest, retrieval, training
from skarn.plans.shared import materialize, ship
from skarn.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '\\A{text.SPACE}+|{text.SPACE}+\\z', '', 'g')"


def _norm_path(c: str) -> str:
    bare = f"regexp_replace(regexp_replace({c}, '[.,;:)''\"`]+$', ''), '/+$', '')"
    return f"lower(regexp_replace(regexp_replace({bare}, '\\{{\\{{[^}}]*\\}}\\}}', '{{}}', 'g'), '\\{{[^}}]*\\}}', '{{}}', 'g'))"


_METHOD_PATH = r"\b(?:GET|POST|PUT|PATCH|DELETE)\b\s*[`''\"]?\s*(/[\w{}\-./]+)"
_VERSIONED = r"/[\w{}\-.]+/v\d+/[\w{}\-./]*"


def _paths_sql(c: str) -> str:
    return f"list_distinct({_every_path_sql(c)})"


def _every_path_sql(c: str) -> str:
    found = f"list_concat(regexp_extract_all(coalesce({c}, ''), '{_METHOD_PATH}', 1), regexp_extract_all(coalesce({c}, ''), '{_VERSIONED}'))"
    normal = f"list_transform({found}, lambda p: {_norm_path('p')})"
    return f"list_filter({normal}, lambda p: length(p) - length(replace(p, '/', '')) >= 2 AND regexp_matches(p, '[a-z]'))"


_TOKENS = (
    "flatten(list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9_]+'), lambda t: list_concat([lower(t)], list_transform(list_filter("
    "regexp_extract_all(regexp_replace(t, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z0-9]+|[A-Z]+'), lambda p: length(p) > 1), lambda p: lower(p)))))"
)
_ORDER = "md5('42|' || {0})"

# -- scans, unions, projections -------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, source, n_chars, module, doc_type FROM documents WHERE n_chars >= 100")
def scan_documents(spark, d):
    return table(spark, d, "documents").where("n_chars >= 100").select("doc_id", "lang", "source", "n_chars", "module", "doc_type")


@query("SELECT example_id, len(messages) AS turns, messages[1].role AS first_role, meta.category AS category, meta.module AS module FROM sft_train")
def scan_chats(spark, d):
    return table(spark, d, "sft_train").select(
        "example_id", F.size("messages").cast("long").alias("turns"), F.get("messages", F.lit(0))["role"].alias("first_role"), "meta.category", "meta.module"
    )


def _union(spark, d) -> DataFrame:
    return corpus.union_sources({"docs": table(spark, d, "all_doc_chunks"), "requests": table(spark, d, "all_postman_chunks")})


_UNION = """(SELECT 0 AS source_no, row_no, id, module, doc_type, source_file, section, text, NULL AS method, NULL AS path FROM all_doc_chunks
             UNION ALL SELECT 1, row_no, id, module, doc_type, source_file, section, text, method, path FROM all_postman_chunks)"""


@query(f"SELECT source_no, row_no, id, section, path, md5(text) AS digest FROM {_UNION}")
def corpus_union(spark, d):
    return _union(spark, d).select("source_no", "row_no", "id", "section", "path", F.md5("text").alias("digest"))


@query(
    f"""SELECT source_no, row_no, coalesce(module, '') AS module, coalesce(doc_type, '') AS doc_type, coalesce(source_file, '') AS source_file,
        coalesce(section, '') AS section, coalesce(method, '') AS method, coalesce(path, '') AS path FROM {_UNION}"""
)
def metadata_projection(spark, d):
    df = _union(spark, d)
    return df.select("source_no", "row_no", *corpus.metadata(df))


#: Module of a source file; other files are 'multi'.
FILE_MODULES = {"cashier.collection.json": "front_office", "housekeeping-app.collection.json": "housekeeping", "members.collection.json": "crm"}


@query(
    """SELECT row_no, CASE source_file WHEN 'cashier.collection.json' THEN 'front_office' WHEN 'housekeeping-app.collection.json' THEN 'housekeeping'
       WHEN 'members.collection.json' THEN 'crm' ELSE 'multi' END AS file_module FROM all_postman_chunks"""
)
def map_lookup(spark, d):
    known = spark.createDataFrame(list(FILE_MODULES.items()), "source_file string, file_module string")
    rows = table(spark, d, "all_postman_chunks").select("row_no", "source_file")
    return rows.join(F.broadcast(known), "source_file", "left").select("row_no", F.coalesce("file_module", F.lit("multi")).alias("file_module"))


@query("SELECT row_no, 'pm-' || substring(md5(coalesce(section, '') || ':' || coalesce(path, '')), 1, 10) AS chunk_id FROM all_postman_chunks")
def chunk_ids(spark, d):
    key = F.concat(F.coalesce("section", F.lit("")), F.lit(":"), F.coalesce("path", F.lit("")))
    return table(spark, d, "all_postman_chunks").select("row_no", text.short_digest(key, 10, "pm-").alias("chunk_id"))


@query(f"SELECT doc_id, md5({_strip("regexp_replace(text, '<[^>]+>', ' ', 'g')")}) AS digest FROM documents")
def strip_html(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.strip_html(F.col("text"))).alias("digest"))


def _clean(c: str) -> str:
    spaced = f"regexp_replace(regexp_replace({c}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')"
    bare = _strip("l")
    kept = f"lambda l: NOT (length({bare}) BETWEEN 1 AND 3 AND NOT regexp_matches({bare}, '^\\p{{L}}'))"
    return _strip(f"array_to_string(list_filter(string_split({spaced}, chr(10)), {kept}), chr(10))")


@query(f"SELECT row_no, length({_clean('text')}) AS chars, md5({_clean('text')}) AS digest FROM all_doc_chunks")
def clean_text(spark, d):
    cleaned = text.clean_text(F.col("text"))
    return table(spark, d, "all_doc_chunks").select("row_no", F.length(cleaned).cast("long").alias("chars"), F.md5(cleaned).alias("digest"))


@query(
    f"""SELECT row_no, md5(CASE WHEN length({_strip("text")}) <= 2000 THEN {_strip("text")}
        ELSE substring({_strip("text")}, 1, 2000) || chr(10) || '... (truncated)' END) AS digest FROM all_postman_chunks"""
)
def truncate_text(spark, d):
    return table(spark, d, "all_postman_chunks").select("row_no", F.md5(text.truncate(F.col("text"))).alias("digest"))


@query(f"SELECT row_no, section FROM all_doc_chunks WHERE length({_clean('text')}) >= 100")
def chunk_min_len(spark, d):
    return table(spark, d, "all_doc_chunks").where(F.length(text.clean_text(F.col("text"))) >= ingest.LEAST).select("row_no", "section")


@query(
    rf"""WITH RECURSIVE w AS (
        SELECT doc_id, text, 0::BIGINT AS st, 1 AS part, CASE WHEN length(text) <= 4000 THEN length(text)::BIGINT ELSE -1 END AS en FROM documents WHERE text IS NOT NULL
        UNION ALL
        SELECT doc_id, text, en2 - 200, part + 1, -1 FROM (
            SELECT *, CASE WHEN st + 4000 < length(text) AND p > 0 THEN st + 2000 + 2000 - (p - 1) - 2 ELSE st + 4000 END AS en2 FROM (
                SELECT *, strpos(reverse(substring(text, st + 2001, 2000)), chr(10) || chr(10)) AS p FROM w WHERE length(text) > 4000))
        WHERE en2 - 200 < length(text))
    SELECT doc_id, part, md5(CASE WHEN length(text) <= 4000 THEN text ELSE
        {_strip("substring(text, st + 1, (CASE WHEN st + 4000 < length(text) AND strpos(reverse(substring(text, st + 2001, 2000)), chr(10) || chr(10)) > 0 "
                "THEN 3999 - strpos(reverse(substring(text, st + 2001, 2000)), chr(10) || chr(10)) ELSE 4000 END))")} END) AS digest FROM w"""
)
def chunk_split(spark, d):
    ship(spark)
    chunks = ingest.chunk_text(table(spark, d, "documents"), "doc_id")
    return chunks.select("doc_id", "part", F.md5("chunk").alias("digest"))


@query(
    """SELECT source_file, count(*) AS rows, min(n) AS min_chars, list_sort(list(n))[count(*) // 2 + 1] AS median_chars, max(n) AS max_chars,
       (sum(n) // count(*))::BIGINT AS mean_chars FROM (SELECT source_file, length(text) AS n FROM all_doc_chunks WHERE text IS NOT NULL) GROUP BY 1"""
)
def text_length_stats(spark, d):
    stats = corpus.length_stats(table(spark, d, "all_doc_chunks"), "source_file")
    return stats.select("source_file", "rows", *[F.col(c).cast("long").alias(c) for c in ("min_chars", "median_chars", "max_chars", "mean_chars")])


@query(
    rf"""WITH parts AS (SELECT doc_id, string_split(regexp_replace(text, '(?m)^(#{{1,2}}\s+.+)$', chr(1) || '\1', 'g'), chr(1)) AS p, starts_with(regexp_replace(text, '(?m)^(#{{1,2}}\s+.+)$', chr(1) || '\1', 'g'), chr(1)) AS led FROM documents),
    each AS (SELECT doc_id, CASE WHEN led THEN p[2:] ELSE p END AS q FROM parts),
    rows AS (SELECT doc_id, unnest(range(len(q))) AS section_no, unnest(q) AS part FROM each),
    cut AS (SELECT doc_id, section_no, length(regexp_extract(part, '^(#{{1,2}})\s+.+', 1)) AS level, {_strip("regexp_extract(part, '^#{1,2}\\s+(.+)', 1)")} AS title,
        {_strip("regexp_replace(part, '^#{1,2}\\s+.+', '')")} AS body FROM rows)
    SELECT doc_id, section_no, level, title, md5(body) AS digest FROM cut WHERE level > 0 OR body <> ''"""
)
def markdown_sections(spark, d):
    sections = ingest.markdown_sections(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return sections.select("doc_id", F.col("section_no").cast("long").alias("section_no"), F.col("level").cast("long").alias("level"), "title", F.md5("body").alias("digest"))


@query(f"SELECT row_no, len({_TOKENS.format('text')}) AS n, md5(array_to_string({_TOKENS.format('text')}, ' ')) AS digest FROM all_doc_chunks")
def tokenize(spark, d):
    t = text.tokens(F.col("text"))
    return table(spark, d, "all_doc_chunks").select("row_no", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


@query(
    """SELECT row_no, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY row_no) > 1 THEN id || '_' || (row_number() OVER (ORDER BY row_no) - 1) ELSE id END AS unique_id
       FROM all_doc_chunks"""
)
def dedup_ids(spark, d):
    return corpus.dedup_ids(table(spark, d, "all_doc_chunks").select("row_no", "id"), "id", ["row_no"]).select("row_no", "unique_id")


@query(
    """SELECT row_no, method, path FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(path, ''), section) ORDER BY row_no) AS r FROM all_postman_chunks)
       WHERE r = 1 AND method IS NOT NULL AND path IS NOT NULL"""
)
def dedup_first(spark, d):
    rows = table(spark, d, "all_postman_chunks").select("row_no", "section", "method", "path")
    key = F.coalesce(F.nullif("path", F.lit("")), "section")
    return corpus.first_by_key(rows, key, ["row_no"], F.col("method").isNotNull() & F.col("path").isNotNull()).select("row_no", "method", "path")


_TASK_KEY = "regexp_replace(lower(replace(id, '_', '-')), '[-.](v|rev|r|alt)[0-9]+$', '')"


@query(
    f"""WITH k AS (SELECT {_TASK_KEY} AS task, id, split FROM benchmark_seed), old AS (SELECT * FROM k WHERE split = 'train'),
        new AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY id) AS r FROM k WHERE split <> 'train' AND task NOT IN (SELECT task FROM old))
        SELECT task, id FROM old UNION ALL SELECT task, id FROM new WHERE r = 1"""
)
def merge_dedup(spark, d):
    key = F.regexp_replace(F.lower(F.replace(F.col("id"), F.lit("_"), F.lit("-"))), "[-.](v|rev|r|alt)[0-9]+$", "")
    tasks = table(spark, d, "benchmark_seed").select(key.alias("task"), "id", "split")
    return curation.merge_new(tasks.where("split = 'train'").drop("split"), tasks.where("split <> 'train'").drop("split"), "task", ["id"]).select("task", "id")


@query("SELECT config, use_rag, coalesce(top_k, 0) AS top_k, coalesce(retrieval, 'none') AS retrieval, prompt_style FROM run_configs")
def config_defaults(spark, d):
    return table(spark, d, "run_configs").select(
        "config", "use_rag", F.coalesce("top_k", F.lit(0)).alias("top_k"), F.coalesce("retrieval", F.lit("none")).alias("retrieval"), "prompt_style"
    )


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events")
def json_explode(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


# -- retrieval ------------------------------------------------------------------------------------------------------


def _vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.col("label").alias("module"))
    return rows.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), rows


_DENSE = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_dot_product(q.v, c.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(c.v, c.v)), 6) AS score
          FROM e q JOIN e c ON q.vec_id <> c.vec_id {0} WHERE q.vec_id % 50 = 0)
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5"""


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norm(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@query(_DENSE.format(""))
def dense_topk(spark, d):
    ship(spark)
    return retrieval.dense_topk(*_vectors(spark, d))


@query(_DENSE.format("AND q.label = c.label"))
def dense_topk_filtered(spark, d):
    ship(spark)
    return retrieval.dense_topk(*_vectors(spark, d), with_filter=True)


def _corpus(spark, d) -> DataFrame:
    """All texts of both chunk tables: (doc_id, text, source_file, section); doc_id is row_no and the table in one number."""
    rows = _union(spark, d).where("text IS NOT NULL AND text <> ''")
    return rows.select((F.col("row_no") * 2 + F.col("source_no")).alias("doc_id"), "text", "source_file", "section")


def _asked(spark, d) -> tuple[DataFrame, DataFrame]:
    """Questions of every fiftieth result, and the index of all texts of both chunk tables."""
    questions = table(spark, d, "eval_results").where("result_id % 50 = 0 AND question IS NOT NULL").select(F.col("result_id").alias("query_id"), "question")
    return questions, retrieval.index_texts(_corpus(spark, d))


_ASKED = "SELECT result_id AS query_id, question FROM eval_results WHERE result_id % 50 = 0 AND question IS NOT NULL"
_SECTIONS = f"SELECT row_no * 2 + source_no AS doc_id, text FROM {_UNION} WHERE text IS NOT NULL AND text <> ''"
_BM25 = f"""
    q AS ({_ASKED}), c AS ({_SECTIONS}), ct AS (SELECT doc_id, {_TOKENS.format("text")} AS t FROM c),
    st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM ct), tf AS (SELECT doc_id, term, count(*)::DOUBLE AS f FROM (SELECT doc_id, unnest(t) AS term FROM ct) GROUP BY ALL),
    df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1), idf0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, st),
    low AS (SELECT 0.25 * avg(idf) AS low FROM idf0), idf AS (SELECT term, CASE WHEN idf < 0 THEN low ELSE idf END AS idf FROM idf0, low),
    qt AS (SELECT query_id, term, count(*)::DOUBLE AS qf FROM (SELECT query_id, unnest({_TOKENS.format("question")}) AS term FROM q) GROUP BY ALL),
    hit AS (SELECT query_id, doc_id, sum(qf * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / mean))) AS s FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN ct USING (doc_id), st GROUP BY ALL),
    sc AS (SELECT q.query_id, c.doc_id, round(coalesce(s, 0), 6) AS score FROM q CROSS JOIN c LEFT JOIN hit USING (query_id, doc_id)),
    bm25 AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)"""


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM bm25 WHERE rank <= 5")
def bm25_topk(spark, d):
    ship(spark)
    return retrieval.bm25_topk(*_asked(spark, d))


def _embedded(name: str, source: str, key: str, column: str) -> str:
    """CTEs that hash-embed a column: ``{name}v`` has (key, slot, value), L2-normalised."""
    return f"""{name}s AS (SELECT {key}, ('0x' || substring(md5(term), 1, 4))::INT % 64 AS slot, count(*)::DOUBLE AS v FROM
        (SELECT {key}, unnest(regexp_extract_all(lower({column}), '[a-z0-9_]+')) AS term FROM {source}) GROUP BY ALL),
        {name}v AS (SELECT {key}, slot, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS v FROM {name}s)"""


def _text_rank(name: str, queries: str, docs: str, key: str) -> str:
    return f"""{name}p AS (SELECT a.{key}, b.doc_id, sum(a.v * b.v) AS s FROM {queries}v a JOIN {docs}v b USING (slot) GROUP BY ALL),
        {name}sc AS (SELECT x.{key}, c.doc_id, round(coalesce(s, 0), 6) AS score FROM (SELECT DISTINCT {key} FROM {queries}) x CROSS JOIN c LEFT JOIN {name}p p ON p.{key} = x.{key} AND p.doc_id = c.doc_id),
        {name} AS (SELECT {key}, doc_id, score, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, doc_id) AS rank FROM {name}sc)"""


_DENSE_TEXT = f"{_embedded('q', 'q', 'query_id', 'question')}, {_embedded('c', 'c', 'doc_id', 'text')}, {_text_rank('dense', 'q', 'c', 'query_id')}"


@query(f"WITH q AS ({_ASKED}), c AS ({_SECTIONS}), {_DENSE_TEXT} SELECT query_id, doc_id, score, rank FROM dense WHERE rank <= 5")
def text_topk(spark, d):
    ship(spark)
    return retrieval.text_topk(*_asked(spark, d))


_HYBRID = """pools AS (SELECT query_id, doc_id, rank FROM dense WHERE rank <= 30 UNION ALL SELECT query_id, doc_id, rank FROM bm25 WHERE rank <= 30),
    fused AS (SELECT query_id, min(doc_id) AS doc_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM pools JOIN c USING (doc_id) GROUP BY query_id, text),
    hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused)"""


@query(f"WITH {_BM25}, {_DENSE_TEXT}, {_HYBRID} SELECT query_id, doc_id, score, rank FROM hybrid WHERE rank <= 5")
def hybrid_rrf(spark, d):
    ship(spark)
    return retrieval.retrieve("hybrid", *_asked(spark, d))


_RERANKED = """reranked AS (SELECT query_id, doc_id, pool_rank, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pool_rank) AS rank FROM (
        SELECT p.query_id, p.doc_id, p.rank AS pool_rank, round(len(list_intersect(a.t, b.t)) / greatest(1, len(a.t)), 6) AS score FROM dense p
        JOIN (SELECT query_id, list_distinct(regexp_extract_all(lower(question), '[a-z0-9_]+')) AS t FROM q) a USING (query_id)
        JOIN (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM c) b USING (doc_id) WHERE p.rank <= 30))"""


@query(f"WITH q AS ({_ASKED}), c AS ({_SECTIONS}), {_DENSE_TEXT}, {_RERANKED} SELECT query_id, doc_id, pool_rank, score, rank FROM reranked WHERE rank <= 5")
def rerank_topk(spark, d):
    ship(spark)
    return retrieval.retrieve("rerank", *_asked(spark, d))


@query(
    f"""WITH q AS ({_ASKED}), c AS ({_SECTIONS}), {_embedded("c", "c", "doc_id", "text")}
    SELECT doc_id, count(v) AS slots, round(coalesce(max(v), 0), 6) AS largest FROM c LEFT JOIN cv USING (doc_id) GROUP BY 1"""
)
def embedded_index(spark, d):
    ship(spark)
    used = F.filter("vector", lambda x: x != 0)
    return retrieval.index_texts(_corpus(spark, d)).select("doc_id", F.size(used).cast("long").alias("slots"), F.round(F.array_max("vector"), 6).alias("largest"))


_SUBS = f"""list_concat([question], list_filter(list_transform(regexp_split_to_array(question, '\\band then\\b|\\bthen\\b|\\bafter that\\b|[;\\n]|\\d\\.\\s'),
    lambda p: {_strip("p")}), lambda p: length(p) > 25))[1:4]"""


def _multi(k: int) -> str:
    """CTEs of the multi-query variant at k; the embedded corpus is there already."""
    return f"""s{k} AS (SELECT query_id, {_SUBS} AS subs FROM q0),
    m{k} AS (SELECT query_id * 8 + sub AS sub_id, query_id, sub, greatest(2, {k} // n) AS share, question FROM (
        SELECT query_id, len(subs) AS n, unnest(range(len(subs))) AS sub, unnest(subs) AS question FROM s{k})),
    {_embedded(f"m{k}", f"m{k}", "sub_id", "question")}, {_text_rank(f"sub{k}", f"m{k}", "c", "sub_id")},
    own{k} AS (SELECT m.query_id, m.sub, d.rank, d.doc_id, d.score, c.text FROM sub{k} d JOIN m{k} m USING (sub_id) JOIN c USING (doc_id) WHERE d.rank <= m.share AND d.rank <= {k}),
    one{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY sub, rank) AS r FROM own{k}) WHERE r = 1),
    multi{k} AS (SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY sub, rank) AS rank FROM one{k}) WHERE rank <= {k})"""


@query(f"SELECT query_id, {_SUBS} AS subs FROM ({_ASKED})")
def multiquery_split(spark, d):
    asked = table(spark, d, "eval_results").where("result_id % 50 = 0 AND question IS NOT NULL").select(F.col("result_id").alias("query_id"), "question")
    return asked.select("query_id", text.subqueries(F.col("question")).alias("subs"))


@query(
    f"""WITH q0 AS ({_ASKED}), c AS ({_SECTIONS}), {_embedded("c", "c", "doc_id", "text")}, {_multi(5)} SELECT query_id, doc_id, score, rank FROM multi5"""
)
def multiquery_topk(spark, d):
    ship(spark)
    return retrieval.multiquery_topk(*_asked(spark, d))


@query("SELECT id, list_distinct(regexp_extract_all(lower(coalesce(expected_answer, '')), '[a-z]{5,}')).list_sort() AS words FROM benchmark_seed")
def gold_words(spark, d):
    return table(spark, d, "benchmark_seed").select("id", F.array_sort(text.gold_words(F.col("expected_answer"))).alias("words"))


@query(
    f"""WITH q0 AS ({_ASKED}), {_BM25}, {_DENSE_TEXT}, {_HYBRID}, {_RERANKED}, {_multi(15)},
    v AS (SELECT 'bm25' AS variant, query_id, doc_id, rank FROM bm25 UNION ALL SELECT 'dense', query_id, doc_id, rank FROM dense
          UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM hybrid UNION ALL SELECT 'rerank', query_id, doc_id, rank FROM reranked
          UNION ALL SELECT 'multiquery', query_id, doc_id, rank FROM multi15),
    g AS (SELECT result_id AS query_id, category, list_filter({_paths_sql("expected_answer")}, lambda p: contains(p, '/v')) AS paths,
          list_distinct(regexp_extract_all(lower(coalesce(expected_answer, '')), '[a-z]{{5,}}')) AS words FROM eval_results WHERE result_id % 50 = 0 AND question IS NOT NULL),
    ctx AS (SELECT variant, k, query_id, string_agg(text, chr(10) ORDER BY rank) AS ctx FROM v JOIN c USING (doc_id), (SELECT unnest([5, 10, 15]) AS k) WHERE rank <= k GROUP BY ALL),
    m AS (SELECT variant, k, category, len(list_intersect(paths, list_distinct(list_transform(regexp_extract_all(ctx, '{_VERSIONED}'), lambda p: {_norm_path("p")})))) AS found,
          len(paths) AS gold, CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda w: contains(lower(ctx), w))) / len(words) ELSE 0.0 END AS cover FROM g JOIN ctx USING (query_id))
    SELECT variant, k, round(100 * sum(found)::DOUBLE / sum(gold), 6) AS path_recall, round(100 * avg(CASE WHEN gold > 0 THEN (found = gold)::INT::DOUBLE END), 6) AS complete_pct,
        round(100 * avg(cover), 6) AS content_cov,
        round(100 * sum(found) FILTER (category = 'api_orchestration')::DOUBLE / sum(gold) FILTER (category = 'api_orchestration'), 6) AS orch_recall,
        count(*) FILTER (gold > 0) AS n_with_paths FROM m GROUP BY ALL"""
)
def retrieval_metrics(spark, d):
    ship(spark)
    questions, index = _asked(spark, d)
    answers = table(spark, d, "eval_results").where("result_id % 50 = 0 AND question IS NOT NULL")
    gold = answers.select(
        F.col("result_id").alias("query_id"), "category", paths.gold(F.col("expected_answer")).alias("gold_paths"), text.gold_words(F.col("expected_answer")).alias("gold_words")
    )
    dense, bm25 = (materialize(retrieval.retrieve(v, questions, index, retrieval.POOL), v) for v in ("dense", "bm25"))
    variants = {
        "bm25": bm25.where("rank <= 15"), "dense": dense.where("rank <= 15"), "hybrid": retrieval.hybrid_rrf([dense, bm25], index, 15),
        "rerank": retrieval.rerank(questions, dense, index, 15), "multiquery": retrieval.retrieve("multiquery", questions, index, 15),
    }
    return retrieval.retrieval_metrics(variants, gold, index, (5, 10, 15))


# -- curation -------------------------------------------------------------------------------------------------------


@query(
    f"""SELECT id, CASE WHEN place <= greatest(1, round_even(n * 0.3::DOUBLE, 0)) THEN 'test' ELSE 'dev' END AS subset FROM (
        SELECT id, row_number() OVER (PARTITION BY module, category ORDER BY {_ORDER.format("id")}, id) AS place, count(*) OVER (PARTITION BY module, category) AS n FROM benchmark_seed)"""
)
def stratified_split(spark, d):
    return curation.stratified_split(table(spark, d, "benchmark_seed").select("id", "module", "category"), ["module", "category"], "id").select("id", "subset")


@query(
    f"""SELECT id, category, difficulty FROM (SELECT *, row_number() OVER (PARTITION BY category, difficulty ORDER BY {_ORDER.format("id")}, id) AS place FROM benchmark_seed)
        WHERE place <= greatest(1, 200 // (SELECT count(*) FROM (SELECT DISTINCT category, difficulty FROM benchmark_seed)))"""
)
def stratified_sample(spark, d):
    return curation.stratified_sample(table(spark, d, "benchmark_seed").select("id", "category", "difficulty"), ["category", "difficulty"], "id", 200)


@query(
    f"""SELECT result_id, category, score FROM (SELECT *, row_number() OVER (PARTITION BY category, score ORDER BY {_ORDER.format("result_id")}, result_id) AS place FROM eval_results WHERE score > 0)
        WHERE place <= (24 + n - 1) // n ORDER BY category NULLS FIRST, score, {_ORDER.format("result_id")}, result_id LIMIT 24""".replace(
        "WHERE place <=", ", (SELECT count(*) AS n FROM (SELECT DISTINCT category, score FROM eval_results WHERE score > 0)) WHERE place <="
    )
)
def stratified_sample_ceil(spark, d):
    rows = evaluation.scored(table(spark, d, "eval_results")).select("result_id", "category", "score")
    return curation.stratified_sample(rows, ["category", "score"], "result_id", 24, up=True)


@query(
    f"""SELECT example_id, CASE WHEN row_number() OVER (ORDER BY {_ORDER.format("example_id")}, example_id) <= greatest(1, floor(0.05 * (SELECT count(*) FROM sft_train)))
        THEN 'val' ELSE 'train' END AS subset FROM sft_train"""
)
def train_val_split(spark, d):
    return curation.train_val_split(table(spark, d, "sft_train").select("example_id"), "example_id")


@query(
    """SELECT row_no, module, turn FROM (SELECT row_no, module, row_number() OVER (PARTITION BY module ORDER BY row_no) AS turn FROM all_postman_chunks WHERE module IS NOT NULL)
       ORDER BY turn, module, row_no LIMIT 650"""
)
def round_robin_sample(spark, d):
    rows = table(spark, d, "all_postman_chunks").where("module IS NOT NULL").select("row_no", "module")
    return curation.round_robin(rows, "module", ["row_no"], 650)


@query(
    """SELECT id, unnest(range(1, 1 + CASE category WHEN 'config_advisory' THEN 3 WHEN 'troubleshooting' THEN 3 WHEN 'api_orchestration' THEN 2 ELSE 1 END)) AS copy_no FROM benchmark_seed"""
)
def upweight(spark, d):
    weights = {"config_advisory": 3, "troubleshooting": 3, "api_orchestration": 2}
    return curation.upweight(table(spark, d, "benchmark_seed").select("id", "category"), "category", weights).select("id", F.col("copy_no").cast("long").alias("copy_no"))


@query(f"SELECT id, {_paths_sql('expected_answer')}.list_sort() AS paths FROM benchmark_seed")
def path_extract(spark, d):
    return table(spark, d, "benchmark_seed").select("id", F.array_sort(paths.extract(F.col("expected_answer"))).alias("paths"))


@query(f"SELECT row_no, {_norm_path('path')} AS path FROM all_postman_chunks WHERE path IS NOT NULL")
def path_normalise(spark, d):
    return table(spark, d, "all_postman_chunks").where("path IS NOT NULL").select("row_no", paths.normalise(F.col("path")).alias("path"))


@query("SELECT row_no, string_split(path, '/')[-1] AS last_segment, len(string_split(path, '/')) - 1 AS depth FROM all_postman_chunks WHERE path IS NOT NULL")
def url_path(spark, d):
    segments = F.split("path", "/")
    return table(spark, d, "all_postman_chunks").where("path IS NOT NULL").select(
        "row_no", F.element_at(segments, -1).alias("last_segment"), (F.size(segments) - 1).cast("long").alias("depth")
    )


_VALID = f"""SELECT {_norm_path("path")} AS path FROM all_postman_chunks WHERE path IS NOT NULL AND path <> ''
    UNION SELECT {_norm_path("p")} FROM (SELECT unnest(regexp_extract_all(text, '{_VERSIONED}')) AS p FROM {_UNION})"""


@query(_VALID)
def valid_paths(spark, d):
    return curation.valid_paths(_union(spark, d))


_CITED = f"SELECT result_id, config, unnest({_paths_sql('generated_answer')}) AS path FROM eval_results WHERE score > 0"


@query(
    f"""WITH v AS ({_VALID}), a AS (SELECT config, result_id, count(*) AS n, count(*) FILTER (v.path IS NULL) AS bad FROM ({_CITED}) c LEFT JOIN v USING (path) GROUP BY ALL)
    SELECT config, count(*) AS answers_with_paths, count(*) FILTER (bad > 0) AS answers_with_bad, sum(n)::BIGINT AS total_paths, sum(bad)::BIGINT AS bad_paths,
        round(100.0 * count(*) FILTER (bad > 0) / count(*), 6) AS answers_bad_pct, round(100.0 * sum(bad) / sum(n), 6) AS bad_path_pct FROM a GROUP BY 1"""
)
def hallucination_rate(spark, d):
    valid = curation.valid_paths(_union(spark, d))
    return curation.hallucination_rate(evaluation.scored(table(spark, d, "eval_results")), valid, "config", "result_id", "generated_answer")


@query(
    f"""WITH v AS ({_VALID}), c AS (SELECT id, unnest(list_filter({_paths_sql("expected_answer")}, lambda p: contains(p, '/v'))) AS path FROM benchmark_seed)
    SELECT id, count(*) AS cited, count(v.path) AS verified, count(*) FILTER (v.path IS NULL) AS missing FROM c LEFT JOIN v USING (path) GROUP BY 1"""
)
def audit_paths(spark, d):
    valid = curation.valid_paths(_union(spark, d))
    return curation.audit_paths(table(spark, d, "benchmark_seed"), valid, "id", "expected_answer")


@query(
    f"""WITH v AS ({_VALID}), c AS (SELECT id, unnest(list_filter({_paths_sql("expected_answer")}, lambda p: contains(p, '/v'))) AS path FROM benchmark_seed),
    a AS (SELECT id, count(*) AS cited, count(v.path) AS verified, count(*) FILTER (v.path IS NULL) AS missing FROM c LEFT JOIN v USING (path) GROUP BY 1)
    SELECT (SELECT count(*) FROM benchmark_seed) AS tasks, count(*) AS tasks_with_paths, count(*) FILTER (missing > 0) AS tasks_with_missing, coalesce(sum(cited), 0)::BIGINT AS cited,
        coalesce(sum(verified), 0)::BIGINT AS verified, coalesce(sum(missing), 0)::BIGINT AS missing FROM a"""
)
def audit_totals(spark, d):
    return curation.audit_totals(audit_paths(spark, d), table(spark, d, "benchmark_seed"))


@query(
    f"""SELECT path, coalesce(list_sort(list_distinct(list(method) FILTER (method IS NOT NULL))), []) AS methods FROM (
        SELECT {_norm_path("path")} AS path, upper(method) AS method FROM all_postman_chunks WHERE path IS NOT NULL AND path <> ''
        UNION SELECT {_norm_path("p")}, NULL FROM (SELECT unnest(regexp_extract_all(text, '{_VERSIONED}')) AS p FROM {_UNION})) GROUP BY 1"""
)
def path_methods(spark, d):
    return curation.path_methods(_union(spark, d))




def _named_sql(c: str) -> str:
    return f"regexp_extract_all(coalesce({c}, ''), '{text.OPERATION_ID}')"


_METHOD_AND_PATH = r"\b(GET|POST|PUT|PATCH|DELETE)\b\s*[`''\"]?\s*/[\w{}\-./]+"


@query(
    f"""WITH pm AS (SELECT path, coalesce(list_sort(list_distinct(list(method) FILTER (method IS NOT NULL))), []) AS methods FROM (
        SELECT {_norm_path("path")} AS path, upper(method) AS method FROM all_postman_chunks WHERE path IS NOT NULL AND path <> ''
        UNION SELECT {_norm_path("p")}, NULL FROM (SELECT unnest(regexp_extract_all(text, '{_VERSIONED}')) AS p FROM {_UNION})) GROUP BY 1),
    t AS (SELECT id, category, expected_answer AS a FROM benchmark_seed),
    call0 AS (SELECT id, unnest(regexp_extract_all(a, '{_METHOD_AND_PATH}', 1)) AS method, unnest(regexp_extract_all(a, '{_METHOD_PATH}', 1)) AS raw FROM t WHERE a IS NOT NULL),
    call AS (SELECT id, method, {_norm_path("raw")} AS path, min(raw) AS raw FROM call0 GROUP BY 1, 2, 3),
    note AS (
        SELECT id, CASE WHEN methods IS NULL THEN 'PATH NOT IN CORPUS: ' || method || ' ' || raw
            WHEN len(methods) > 0 AND NOT list_contains(methods, method) THEN 'METHOD MISMATCH: reference says ' || method || ' ' || raw || '; corpus has ' || array_to_string(methods, '/') END AS n
        FROM call LEFT JOIN pm USING (path)
        UNION SELECT id, 'PATH NOT IN CORPUS: ' || path FROM (SELECT id, unnest(list_filter({_paths_sql("a")}, lambda p: contains(p, '/v'))) AS path FROM t) b
            WHERE path NOT IN (SELECT path FROM pm) AND NOT EXISTS (SELECT 1 FROM call WHERE call.id = b.id AND call.path = b.path)
        UNION SELECT id, 'OPERATION ID NOT IN CORPUS: ' || o FROM (SELECT id, unnest({_named_sql("a")}) AS o FROM t)
            WHERE regexp_matches(o, '{text.OPERATION_VERB}') AND lower(o) NOT IN (SELECT lower(unnest({_named_sql("text")})) FROM all_postman_chunks)
        UNION SELECT id, 'CONTROL/SETTING NOT FOUND IN DOCS: ' || chr(39) || p || chr(39) FROM (SELECT id, unnest(regexp_extract_all(a, '{text.CAPITALISED_PHRASE}')) AS p FROM t WHERE category = 'config_advisory')
            WHERE lower(p) NOT IN (SELECT ph FROM (SELECT DISTINCT lower(unnest(regexp_extract_all(a, '{text.CAPITALISED_PHRASE}'))) AS ph FROM t WHERE category = 'config_advisory'),
                (SELECT string_agg(lower(text), chr(1)) AS every FROM {_UNION}) WHERE contains(every, ph))),
    f AS (SELECT id, string_agg(DISTINCT n, ' | ' ORDER BY n) AS findings FROM note WHERE n IS NOT NULL GROUP BY 1)
    SELECT id, CASE WHEN findings IS NULL THEN 'CLEAN' ELSE 'CHECK' END AS verdict, coalesce(findings, '') AS findings FROM benchmark_seed LEFT JOIN f USING (id)"""
)
def verify_claims(spark, d):
    requests = table(spark, d, "all_postman_chunks")
    texts = _union(spark, d).select(F.lower("text").alias("text"))
    named = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(text.OPERATION_ID), 0)))
    operations = requests.select(named.alias("o")).select(F.lower("o").alias("operation")).distinct()
    return curation.verify_claims(table(spark, d, "benchmark_seed"), curation.path_methods(_union(spark, d)), texts, operations)


# -- evaluation -----------------------------------------------------------------------------------------------------


@query("SELECT lang, count(*) AS rows FROM documents GROUP BY 1")
def count_by_lang(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("rows"))


@query(
    " UNION ALL ".join(f"SELECT '{c}' AS field, {c}::VARCHAR AS value, count(*) AS rows FROM benchmark_seed GROUP BY 2" for c in ("module", "category", "difficulty", "split"))
)
def stats_grouping_sets(spark, d):
    return corpus.counts_by(table(spark, d, "benchmark_seed"), ["module", "category", "difficulty", "split"])


@query("SELECT result_id, score FROM eval_results WHERE coalesce(score, -1) > 0")
def filter_scored(spark, d):
    return evaluation.scored(table(spark, d, "eval_results")).select("result_id", "score")


@query(
    "SELECT config, count(*) AS n, round(avg(score), 6) AS mean_score, "
    + ", ".join(f"count(*) FILTER (score = {s}) AS s{s}" for s in range(1, 6))
    + " FROM eval_results WHERE score > 0 GROUP BY 1"
)
def score_histogram(spark, d):
    return evaluation.histogram(table(spark, d, "eval_results"), "config")


@query(
    " UNION ALL ".join(
        f"SELECT config, '{c}' AS field, {c} AS value, count(*) AS n, round(avg(score), 6) AS mean_score FROM eval_results WHERE score > 0 GROUP BY 1, 3"
        for c in ("category", "difficulty", "module")
    )
)
def score_breakdown(spark, d):
    return evaluation.breakdown(table(spark, d, "eval_results"), "config", ["category", "difficulty", "module"])


@query("SELECT config, round(avg(latency_seconds), 6) AS mean_latency FROM eval_results WHERE latency_seconds >= 0 GROUP BY 1")
def latency_avg(spark, d):
    rows = table(spark, d, "eval_results").where("latency_seconds >= 0")
    return rows.groupBy("config").agg(F.round(F.avg("latency_seconds"), 6).alias("mean_latency"))


@query(
    """SELECT config, count(*) AS n, round(avg(l), 6) AS mean_s, round(quantile_cont(l, 0.5), 6) AS p50_s, round(quantile_cont(l, 0.9), 6) AS p90_s,
       round(quantile_cont(l, 0.95), 6) AS p95_s, round(max(l), 6) AS max_s, round(quantile_cont(c::DOUBLE, 0.5), 6) AS median_chars, round(1000 * sum(l) / sum(c), 6) AS ms_per_char
       FROM (SELECT config, latency_seconds AS l, length(generated_answer) AS c FROM eval_results WHERE latency_seconds >= 0) GROUP BY 1"""
)
def latency_percentiles(spark, d):
    return evaluation.latency(table(spark, d, "eval_results").withColumn("chars", F.length("generated_answer")), "config", "chars")


@query(
    """SELECT config, count(*) FILTER (score > 0) AS n, count(*) FILTER (score = -1) AS n_failed, round(avg(score) FILTER (score > 0), 6) AS mean_score,
       round(100.0 * count(*) FILTER (score >= 4) / nullif(count(*) FILTER (score > 0), 0), 6) AS usable_pct,
       round(100.0 * count(*) FILTER (score BETWEEN 1 AND 2) / nullif(count(*) FILTER (score > 0), 0), 6) AS wrong_pct,
       round(quantile_cont(latency_seconds, 0.5) FILTER (latency_seconds >= 0), 6) AS median_latency_s,
       round(quantile_cont(latency_seconds, 0.95) FILTER (latency_seconds >= 0), 6) AS p95_latency_s,
       round(quantile_cont(length(coalesce(generated_answer, ''))::DOUBLE, 0.5), 6) AS median_chars FROM eval_results GROUP BY 1"""
)
def config_table(spark, d):
    return evaluation.config_table(table(spark, d, "eval_results"), "config")


@query(
    r"""SELECT row_no, CASE WHEN n <= 3 THEN 'basic' WHEN n <= 6 THEN 'intermediate' ELSE 'advanced' END AS difficulty FROM (
        SELECT row_no, len(list_distinct(regexp_extract_all(text, '(?m)^\s*(?:GET|POST|PUT|PATCH|DELETE) /\S+'))) AS n FROM all_postman_chunks WHERE text IS NOT NULL)"""
)
def difficulty_bucket(spark, d):
    calls = F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:GET|POST|PUT|PATCH|DELETE) /\S+"), 0)
    return table(spark, d, "all_postman_chunks").where("text IS NOT NULL").select("row_no", training.difficulty(calls).alias("difficulty"))


@query()
def config_report(spark, d):
    """The report row with the bootstrap interval of the mean and the share of invalid paths."""
    results = table(spark, d, "eval_results")
    return evaluation.config_report(results, evaluation.task_scores(results), hallucination_rate(spark, d))


def _simpson_sql(f: str, upper: str) -> str:
    """Integral of ``f`` (of x) from 0 to ``upper``, as the operators take it."""
    n = evaluation.STEPS
    weight = f"CASE WHEN i IN (0, {n}) THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
    return f"(list_sum(list_transform(range({n + 1}), lambda i: ({weight})::DOUBLE * {f.replace('{x}', f'(i * ({upper}) / {n})')})) * ({upper}) / {3 * n})"


def _normal_sql(z: str) -> str:
    return f"greatest(0, 1 - 2 / sqrt(2 * pi()) * {_simpson_sql('exp(-{x} * {x} / 2)', f'least(abs({z}), 10.0)')})"


def _chi_square_sql(x: str, df: str) -> str:
    """For odd and even degrees of freedom, the finite sums with the gamma function."""
    odd = f"list_sum(list_transform(range((({df}) - 1) // 2), lambda k: pow({x}, k) * sqrt(pi()) / (pow(2, k + 1) * gamma(k + 1.5))))"
    even = f"list_sum(list_transform(range(({df}) // 2), lambda k: pow({x} / 2, k) / gamma(k + 1)))"
    tail = f"{_normal_sql(f'sqrt({x})')} + sqrt(2 * {x} / pi()) * exp(-{x} / 2) * coalesce({odd}, 0)"
    return f"CASE WHEN {x} <= 0 THEN 1.0 WHEN ({df}) % 2 = 0 THEN exp(-{x} / 2) * {even} WHEN {x} IS NOT NULL THEN least(1.0, {tail}) END"


#: The planned comparisons.
COMPARISONS = (
    ("mini3-plain", "mini3-rag"), ("mini3-plain", "mini3-tuned"), ("mini3-rag", "mini3-tuned-rag"), ("mini3-rag", "mini3-rag-strict"),
    ("mid7-plain", "mid7-rag"), ("mid7-rag", "mid7-rag-rerank"), ("large-plain", "large-rag"),
)
_SCORES = "sc AS (SELECT task_id AS task, config, avg(score) AS score FROM eval_results WHERE score > 0 GROUP BY ALL)"
_PAIRED = (
    f"{_SCORES}, cmp(label_a, label_b) AS (VALUES "
    + ", ".join(f"('{a}', '{b}')" for a, b in COMPARISONS)
    + "), df AS (SELECT label_a, label_b, a.task, a.score AS a, b.score AS b, b.score - a.score AS diff FROM cmp JOIN sc a ON a.config = label_a JOIN sc b ON b.config = label_b AND b.task = a.task)"
)


def _diffs(spark, d) -> DataFrame:
    planned = spark.createDataFrame(list(COMPARISONS), "label_a string, label_b string")
    return evaluation.paired(evaluation.task_scores(table(spark, d, "eval_results")), planned)


@query(
    f"""WITH {_PAIRED} SELECT label_a, label_b, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(diff), 6) AS delta,
        count(*) FILTER (diff > 0) AS wins, count(*) FILTER (diff < 0) AS losses, count(*) FILTER (diff = 0) AS ties FROM df GROUP BY ALL"""
)
def paired_compare(spark, d):
    return evaluation.paired_summary(_diffs(spark, d))


@query(
    f"""WITH {_PAIRED}, r0 AS (SELECT label_a, label_b, diff, round(abs(diff), 9) AS size FROM df WHERE diff <> 0),
    r AS (SELECT *, rank() OVER (PARTITION BY label_a, label_b ORDER BY size) + (count(*) OVER (PARTITION BY label_a, label_b, size) - 1) / 2.0 AS rk FROM r0),
    t AS (SELECT label_a, label_b, sum(c * c * c - c)::DOUBLE AS tie FROM (SELECT label_a, label_b, size, count(*) AS c FROM r0 GROUP BY ALL) GROUP BY ALL),
    w AS (SELECT label_a, label_b, count(*) AS n, coalesce(sum(rk) FILTER (diff > 0), 0)::DOUBLE AS wp, coalesce(sum(rk) FILTER (diff < 0), 0)::DOUBLE AS wm FROM r GROUP BY ALL)
    SELECT label_a, label_b, n, round(wp, 6) AS w_plus, round(wm, 6) AS w_minus,
        round(z, 6) AS z, round({_normal_sql("z")}, 6) AS p FROM (
        SELECT *, (least(wp, wm) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2.0 * n + 1) / 24.0 - tie / 48.0) AS z FROM w JOIN t USING (label_a, label_b))"""
)
def wilcoxon_stat(spark, d):
    return evaluation.signed_ranks(_diffs(spark, d))


@query(
    f"""WITH {_SCORES}, kk AS (SELECT count(DISTINCT config)::DOUBLE AS k FROM sc), f AS (SELECT * FROM sc WHERE task IN (SELECT task FROM sc GROUP BY 1 HAVING count(*) = (SELECT k FROM kk))),
    c AS (SELECT DISTINCT task_id AS task, category FROM eval_results WHERE score > 0 AND category IS NOT NULL UNION SELECT task_id, 'ALL' FROM eval_results WHERE score > 0),
    r AS (SELECT *, rank() OVER (PARTITION BY task ORDER BY score DESC) + (count(*) OVER (PARTITION BY task, score) - 1) / 2.0 AS rk FROM f),
    s AS (SELECT category, config, sum(rk)::DOUBLE AS r, count(*)::DOUBLE AS n FROM r JOIN c USING (task) GROUP BY ALL HAVING count(*) >= 3),
    t AS (SELECT category, sum(c * c * c - c)::DOUBLE AS tie FROM (SELECT category, task, score, count(*) AS c FROM f JOIN c USING (task) GROUP BY ALL) GROUP BY 1),
    x AS (SELECT category, sum(r * r) AS ss FROM s GROUP BY 1)
    SELECT category, config, round(r / n, 6) AS mean_rank, row_number() OVER (PARTITION BY category ORDER BY round(r / n, 6), config) AS place, n::BIGINT AS tasks,
        round(chi, 6) AS chi_square, round({_chi_square_sql("chi", "k::INT - 1")}, 6) AS p FROM (
        SELECT *, (12 / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / nullif(1 - tie / nullif(n * k * (k * k - 1), 0), 0) AS chi
        FROM s JOIN t USING (category) JOIN x USING (category), kk)"""
)
def friedman_ranks(spark, d):
    """Task by task, over the tasks that every configuration answered, for ALL and each category."""
    results = table(spark, d, "eval_results")
    judged = evaluation.scored(results).select(F.col("task_id").alias("task"), "category")
    categories = judged.where("category IS NOT NULL").union(judged.withColumn("category", F.lit("ALL"))).distinct()
    return evaluation.friedman_by(evaluation.task_scores(results), categories)


_RATERS = """pr AS (SELECT a.score AS human, b.score AS judge FROM (SELECT task_id, min(score) AS score FROM eval_results WHERE score > 0 AND config = 'mini3-rag' GROUP BY 1) a
    JOIN (SELECT task_id, max(score) AS score FROM eval_results WHERE score > 0 AND config = 'mid7-rag' GROUP BY 1) b USING (task_id))"""


def _raters(spark, d) -> DataFrame:
    rows = evaluation.scored(table(spark, d, "eval_results"))
    a = rows.where("config = 'mini3-rag'").groupBy("task_id").agg(F.min("score").alias("human"))
    b = rows.where("config = 'mid7-rag'").groupBy("task_id").agg(F.max("score").alias("judge"))
    return a.join(b, "task_id").select("human", "judge")


@query(
    f"""WITH {_RATERS} SELECT count(*) AS n, round(avg((human = judge)::INT), 6) AS exact, round(avg((abs(judge - human) <= 1)::INT), 6) AS within1,
        round(avg(judge - human), 6) AS mean_bias FROM pr"""
)
def judge_agreement(spark, d):
    return evaluation.agreement(_raters(spark, d))


@query(
    f"""WITH {_RATERS}, lb AS (SELECT l, row_number() OVER (ORDER BY l) AS i FROM (SELECT human AS l FROM pr UNION SELECT judge FROM pr)),
    o AS (SELECT h.i AS hi, j.i AS ji, count(pr.human)::DOUBLE AS o FROM lb h CROSS JOIN lb j LEFT JOIN pr ON pr.human = h.l AND pr.judge = j.l GROUP BY ALL),
    e AS (SELECT *, sum(o) OVER (PARTITION BY hi) * sum(o) OVER (PARTITION BY ji) / sum(o) OVER () AS e FROM o)
    SELECT round(1 - sum(abs(hi - ji) * o) / sum(abs(hi - ji) * e), 6) AS kappa_linear, round(1 - sum((hi - ji) * (hi - ji) * o) / sum((hi - ji) * (hi - ji) * e), 6) AS kappa_quadratic FROM e"""
)
def weighted_kappa(spark, d):
    return evaluation.kappa(_raters(spark, d))


@query(
    """WITH v AS (SELECT latency_seconds AS x, score::DOUBLE AS y FROM eval_results WHERE score > 0 AND latency_seconds >= 0),
    r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM v)
    SELECT n::BIGINT AS n, round(c, 6) AS rho, round(CASE WHEN n > 2 THEN greatest(0, 1 - """
    + _simpson_sql("pow(greatest(0, cos({x} / sqrt(n - 2))), n - 3)", "least(sqrt(n - 2) * atan(abs(c) / sqrt(1 - c * c)), least(sqrt(n - 2) * pi() / 2, 12.0))")
    + " / "
    + _simpson_sql("pow(greatest(0, cos({x} / sqrt(n - 2))), n - 3)", "least(sqrt(n - 2) * pi() / 2, 12.0)")
    + """) END, 6) AS p FROM (SELECT count(*)::DOUBLE AS n, corr(rx, ry) AS c FROM r)"""
)
def spearman(spark, d):
    rows = evaluation.scored(table(spark, d, "eval_results")).where("latency_seconds >= 0")
    return evaluation.spearman(rows.select(F.col("latency_seconds").alias("x"), F.col("score").cast("double").alias("y")))


@query()
def bootstrap_ci(spark, d):
    return evaluation.bootstrap(evaluation.task_scores(table(spark, d, "eval_results")), "config", "score")


@query()
def paired_bootstrap(spark, d):
    named = _diffs(spark, d).withColumn("comparison", F.concat("label_a", F.lit(" -> "), "label_b"))
    return evaluation.bootstrap(named, "comparison", "diff")


# -- training sets --------------------------------------------------------------------------------------------------


@query("SELECT example_id, messages[1:2] AS prompt, messages[3:] AS completion FROM sft_train WHERE messages IS NOT NULL")
def sft_prompt_completion(spark, d):
    return training.prompt_completion(table(spark, d, "sft_train").where("messages IS NOT NULL")).select("example_id", "prompt", "completion")


_STATS = """SELECT '{0}' AS field, {1} AS value, count(*) AS examples, min(n)::BIGINT AS min_chars, list_sort(list(n))[count(*) // 2 + 1]::BIGINT AS median_chars,
    max(n)::BIGINT AS max_chars FROM (SELECT meta, list_sum(list_transform(messages, lambda m: length(coalesce(m.content, '')))) AS n FROM sft_train WHERE messages IS NOT NULL) GROUP BY 2"""


@query(" UNION ALL ".join(_STATS.format(n, v) for n, v in (("all", "NULL::VARCHAR"), ("category", "meta.category"), ("module", "meta.module"))))
def sft_stats(spark, d):
    size = F.aggregate("messages", F.lit(0), lambda s, m: s + F.length(F.coalesce(m["content"], F.lit(""))))
    stats = training.set_stats(table(spark, d, "sft_train").where("messages IS NOT NULL"), size, {"category": F.col("meta.category"), "module": F.col("meta.module")})
    return stats.select("field", "value", "examples", *[F.col(c).cast("long").alias(c) for c in ("min_chars", "median_chars", "max_chars")])


_ACTION = f"""regexp_replace(lower(substring(x, 1, 1)) || substring(x, 2), '\\.+$', '') FROM (SELECT row_no, regexp_replace(CASE WHEN {_strip("coalesce(section, '')")} <> ''
    THEN {_strip("section")} ELSE split_part({_strip("coalesce(text, '')")}, '.', 1) END, '\\s+', ' ', 'g') AS x FROM all_doc_chunks)"""


@query(f"SELECT row_no, {_ACTION.split(' FROM ', 1)[0]} AS action FROM {_ACTION.split(' FROM ', 1)[1]}")
def action_phrase(spark, d):
    return table(spark, d, "all_doc_chunks").select("row_no", text.action_phrase(F.col("section"), F.col("text")).alias("action"))


TEMPLATES = ("Which call do you need to {action}?", "How do I {action} over the interface?", "What is the method and path used to {action}?")


@query(
    f"""SELECT row_no, replace({list(TEMPLATES)!r}[1 + ('0x' || substring(md5('42|' || row_no), 1, 8))::BIGINT % 3], '{{action}}', action) AS question FROM (
        SELECT row_no, {_ACTION.split(" FROM ", 1)[0]} AS action FROM {_ACTION.split(" FROM ", 1)[1]})"""
)
def question_template(spark, d):
    action = text.action_phrase(F.col("section"), F.col("text"))
    asked = training.question_from(list(TEMPLATES), action, F.col("row_no").cast("string"))
    return table(spark, d, "all_doc_chunks").select("row_no", asked.alias("question"))


@query("SELECT result_id, score, reason FROM (SELECT result_id, coalesce(score, -1) AS score, coalesce(score_reason, '') AS reason FROM eval_results)")
def parse_judge(spark, d):
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct("score", F.col("score_reason").alias("reason"))), F.lit("\n```"))
    return table(spark, d, "eval_results").select("result_id", training.parse_judgement(reply).alias("j")).select("result_id", "j.score", "j.reason")


def _retrieved(spark, d) -> DataFrame:
    """Questions of every fiftieth result with their five best texts and the expected answer, and the chunk it names first."""
    ship(spark)
    requests = _corpus(spark, d)
    hits = retrieval.retrieve("bm25", *_asked(spark, d))
    chunk = F.struct(
        "rank", F.struct("text", "source_file", "section", (1.0 / (1.0 + F.col("score"))).alias("distance"), F.lit(False).alias("protected")).alias("c")
    )
    contexts = hits.join(requests, "doc_id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(chunk)), lambda s: s["c"]).alias("chunks"))
    answers = table(spark, d, "eval_results").where("expected_answer IS NOT NULL").select(
        F.col("result_id").alias("query_id"), "question", F.col("expected_answer").alias("gold_answer"), "category", "module", F.get(paths.grounding(F.col("expected_answer")), F.lit(0)).alias("path")
    )
    sources = _lookup(spark, d).withColumnRenamed("text", "source_text")
    return answers.join(contexts, "query_id").join(sources, "path", "left").drop("path")


def _lookup(spark, d) -> DataFrame:
    rows = table(spark, d, "all_postman_chunks").where("path IS NOT NULL AND path <> '' AND text IS NOT NULL")
    return rows.groupBy("path").agg(F.min_by("text", "row_no").alias("text"))


@query()
def build_prompt(spark, d):
    return _retrieved(spark, d).select("query_id", F.md5(training.user_prompt(F.col("question"), F.col("chunks"))).alias("digest"))


_CONTEXT = f"""{_BM25},
    look AS (SELECT path, arg_min(text, row_no) AS source_text FROM all_postman_chunks WHERE path IS NOT NULL AND path <> '' AND text IS NOT NULL GROUP BY 1),
    hit5 AS (SELECT query_id, rank, score, c.text, u.source_file, u.section FROM bm25 JOIN c USING (doc_id) JOIN (SELECT row_no * 2 + source_no AS doc_id, source_file, section FROM {_UNION}) u USING (doc_id) WHERE rank <= 5),
    gave AS (SELECT query_id, list(text ORDER BY rank) AS texts, list('[Source ' || rank || ': ' || coalesce(source_file, '') || ' — ' || coalesce(section, '') || ']' || chr(10) || text ORDER BY rank) AS told
             FROM hit5 GROUP BY 1),
    want AS (SELECT result_id AS query_id, question, expected_answer AS gold, list_distinct(list_transform(regexp_extract_all(expected_answer, '{paths.GROUNDING_PATH}'),
             lambda p: regexp_replace(p, '[.,;:)]+$', ''))) AS gold_paths, regexp_replace(regexp_extract(expected_answer, '{paths.GROUNDING_PATH}'), '[.,;:)]+$', '') AS path
             FROM eval_results WHERE expected_answer IS NOT NULL)"""


@query(
    f"""WITH {_CONTEXT} SELECT query_id, md5('Context:' || chr(10) || array_to_string(told, chr(10) || chr(10) || '---' || chr(10) || chr(10)) || chr(10) || chr(10) || 'Question: ' || question) AS digest
        FROM want JOIN gave USING (query_id)"""
)
def build_prompt(spark, d):
    return _retrieved(spark, d).select("query_id", F.md5(training.user_prompt(F.col("question"), F.col("chunks"))).alias("digest"))


def _source() -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.col("source_text").alias("text"), none.alias("source_file"), none.alias("section"), F.lit(0.0).alias("distance"), F.lit(True).alias("protected"))


@query(
    f"""WITH {_CONTEXT} SELECT query_id, len(texts) - put::INT * (len(texts) >= 5)::INT + put::INT AS n,
        CASE WHEN put THEN 1 + ('0x' || substring(md5('42|' || query_id), 1, 8))::BIGINT % (least(4, len(texts)) + 1) ELSE 0 END AS slot
        FROM (SELECT *, source_text IS NOT NULL AND NOT list_contains(texts, source_text) AS put FROM want JOIN gave USING (query_id) LEFT JOIN look USING (path))"""
)
def inject_gold(spark, d):
    """The source chunk of the first path of the answer is put in where it was not retrieved; slot 0 where nothing was."""
    given = _retrieved(spark, d).select("query_id", training.inject(F.col("chunks"), _source(), F.col("query_id").cast("string")).alias("chunks"))
    return given.select("query_id", F.size("chunks").alias("n"), F.array_position(F.transform("chunks", lambda c: c["protected"]), True).alias("slot"))


@query(
    f"""WITH {_CONTEXT}, miss AS (SELECT query_id, texts, list_filter(gold_paths, lambda p: NOT contains(array_to_string(texts, chr(10)), p)) AS gone, gold_paths FROM want JOIN gave USING (query_id)),
    got AS (SELECT query_id, list(source_text) AS extra, count(*) AS n FROM (SELECT DISTINCT query_id, path, source_text FROM (SELECT query_id, unnest(gone) AS path FROM miss) JOIN look USING (path)) GROUP BY 1),
    ctx AS (SELECT m.query_id, list_concat(texts[1:greatest(0, 5 - coalesce(n, 0))], coalesce(extra, [])) AS texts, gold_paths FROM miss m LEFT JOIN got USING (query_id))
    SELECT query_id, len(texts) AS n, len(list_filter(gold_paths, lambda p: NOT contains(array_to_string(texts, chr(10)), p))) = 0 AS grounded FROM ctx"""
)
def grounding_check(spark, d):
    return training.ground(_retrieved(spark, d), _lookup(spark, d)).select("query_id", F.size("chunks").alias("n"), "grounded")


SYSTEM = "You answer questions about the interface of a hotel system from the given context."


@query()
def trim_to_budget(spark, d):
    trimmed = training.trim(training.ground(_retrieved(spark, d), _lookup(spark, d)), system_chars=len(SYSTEM))
    return trimmed.select("query_id", F.size("chunks").alias("n"), "grounded", "grounded_after_trim")


@query()
def sft_build(spark, d):
    """The training set end to end: retrieval, source chunk, grounding, budget, messages, split."""
    return training.build_set(_retrieved(spark, d), _lookup(spark, d), SYSTEM)


@query(
    """SELECT result_id, list_transform(chunk_distances, lambda x, i: i || '. **?** — ? (distance: ' || printf('%.3f', round(x::DECIMAL(18, 10), 3)::DOUBLE) || ')') AS sources FROM eval_results
       WHERE chunk_distances IS NOT NULL AND len(list_filter(chunk_distances, lambda x: x IS NULL)) = 0"""
)
def answer_sources(spark, d):
    none = F.lit(None).cast("string")
    rows = table(spark, d, "eval_results").where(F.col("chunk_distances").isNotNull() & ~F.exists("chunk_distances", lambda x: x.isNull()))
    chunks = F.transform("chunk_distances", lambda x: F.struct(none.alias("source_file"), none.alias("section"), F.round(x, 3).alias("distance")))
    return rows.select("result_id", training.source_lines(chunks).alias("sources"))


@query("SELECT config, model, use_rag, CASE WHEN prompt_style = 'strict' THEN 10 ELSE top_k END AS top_k, retrieval, prompt_style FROM run_configs")
def config_overrides(spark, d):
    configs = table(spark, d, "run_configs")
    return training.with_overrides(configs, configs.where("prompt_style = 'strict'").select("config", F.lit(10).alias("top_k")))


# -- rows, joins and set operations of the evaluation flow ----------------------------------------------------------


@query("SELECT result_id, task_id, config, use_rag, coalesce(num_chunks_retrieved, 0) AS n_chunks, round(latency_seconds, 2) AS latency FROM eval_results")
def eval_rows(spark, d):
    return table(spark, d, "eval_results").select(
        "result_id", "task_id", "config", "use_rag", F.coalesce("num_chunks_retrieved", F.lit(0)).alias("n_chunks"), F.round("latency_seconds", 2).alias("latency")
    )


@query("SELECT id, coalesce(required_operations, []) AS required_operations, coalesce(evaluation_criteria, '') AS criteria, coalesce(source, 'unknown') AS source FROM benchmark_seed")
def default_fill(spark, d):
    return table(spark, d, "benchmark_seed").select(
        "id", F.coalesce("required_operations", F.array().cast("array<string>")).alias("required_operations"),
        F.coalesce("evaluation_criteria", F.lit("")).alias("criteria"), F.coalesce("source", F.lit("unknown")).alias("source"),
    )


@query(
    r"""SELECT row_no, contains(text, 'body:') OR contains(text, 'Body:') AS has_body, len(regexp_extract_all(text, '(?m)^Step \d+:')) AS steps
        FROM all_postman_chunks WHERE text IS NOT NULL"""
)
def request_shape(spark, d):
    steps = F.size(F.regexp_extract_all("text", F.lit(r"(?m)^Step \d+:"), 0)).cast("long")
    has_body = F.contains("text", F.lit("body:")) | F.contains("text", F.lit("Body:"))
    return table(spark, d, "all_postman_chunks").where("text IS NOT NULL").select("row_no", has_body.alias("has_body"), steps.alias("steps"))


@query(r"SELECT row_no, string_split(regexp_extract(text, '(?m)^Query parameters: (.*)$', 1), ', ')[1:5] AS parameters FROM all_postman_chunks WHERE contains(text, 'Query parameters: ')")
def query_parameters(spark, d):
    listed = F.regexp_extract("text", r"(?m)^Query parameters: (.*)$", 1)
    rows = table(spark, d, "all_postman_chunks").where(F.contains("text", F.lit("Query parameters: ")))
    return rows.select("row_no", F.slice(F.split(listed, ", "), 1, 5).alias("parameters"))


@query(
    f"""SELECT id, array_to_string(list_transform(list_filter(l, lambda p, i: list_position(l, p) = i), lambda p, i: i || '. ' || p), chr(10)) AS steps
        FROM (SELECT id, {_every_path_sql("expected_answer")} AS l FROM benchmark_seed) WHERE len(l) > 0"""
)
def numbered_steps(spark, d):
    found = paths.extract(F.col("expected_answer"))
    numbered = F.array_join(F.transform(found, lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p)), "\n")
    return table(spark, d, "benchmark_seed").where(F.size(found) > 0).select("id", numbered.alias("steps"))


@query(
    """SELECT row_no, '`' || method || ' ' || path || '`' || CASE WHEN module IS NULL THEN '' ELSE ' (operationId `' || module || '`)' END || '.'
       || CASE WHEN s = '' THEN '' WHEN ends_with(s, '.') THEN ' ' || s ELSE ' ' || s || '.' END
       || CASE WHEN len(r) > 0 THEN ' Required parameters: ' || array_to_string(r[1:6], ', ') || '.' ELSE '' END AS answer FROM (
       SELECT row_no, method, path, module, regexp_replace(coalesce(section, ''), '^\\s+|\\s+$', '', 'g') AS s, regexp_extract_all(path, '\\{([^}]+)\\}', 1) AS r
       FROM all_postman_chunks WHERE method IS NOT NULL AND path IS NOT NULL)"""
)
def call_answers(spark, d):
    rows = table(spark, d, "all_postman_chunks").where("method IS NOT NULL AND path IS NOT NULL")
    required = F.regexp_extract_all("path", F.lit(r"\{([^}]+)\}"), 1)
    return rows.select("row_no", training.call_answer(F.col("method"), F.col("path"), F.col("module"), F.col("section"), required).alias("answer"))


@query("SELECT config, CASE WHEN NOT use_rag THEN 'plain' WHEN prompt_style = 'strict' THEN 'strict' ELSE 'grounded' END AS prompt FROM run_configs")
def system_prompts(spark, d):
    return table(spark, d, "run_configs").select("config", training.system_prompt(F.col("use_rag"), F.col("prompt_style"), "plain", "grounded", "strict").alias("prompt"))


@query(
    """SELECT result_id, md5('Score 1 to 5. QUESTION:' || chr(10) || coalesce(question, '') || chr(10) || chr(10) || 'EXPECTED ANSWER:' || chr(10) || coalesce(expected_answer, '')
       || chr(10) || chr(10) || 'GENERATED ANSWER:' || chr(10) || coalesce(generated_answer, '') || chr(10) || chr(10) || '{"score": 1}') AS digest FROM eval_results"""
)
def judge_prompts(spark, d):
    template = 'Score 1 to 5. QUESTION:\n{question}\n\nEXPECTED ANSWER:\n{expected_answer}\n\nGENERATED ANSWER:\n{generated_answer}\n\n{"score": 1}'
    prompt = training.judge_prompt(template, ["question", "expected_answer", "generated_answer"])
    return table(spark, d, "eval_results").select("result_id", F.md5(prompt).alias("digest"))


@query("SELECT result_id, task_id, config FROM eval_results e WHERE NOT EXISTS (SELECT 1 FROM eval_results s WHERE s.score > 0 AND s.task_id = e.task_id AND s.config = e.config)")
def resume_unscored(spark, d):
    from skarn.streaming.incremental import unjudged

    rows = table(spark, d, "eval_results")
    return unjudged(rows.select("result_id", "task_id", "config"), rows.select("task_id", "config", "score")).select("result_id", "task_id", "config")


@query("SELECT b.category, e.config, count(*) AS n FROM eval_results e JOIN benchmark_seed b ON e.task_id = b.id GROUP BY ALL")
def results_with_tasks(spark, d):
    tasks = table(spark, d, "benchmark_seed").select(F.col("id").alias("task_id"), F.col("category").alias("task_category"))
    joined = table(spark, d, "eval_results").select("task_id", "config").join(tasks, "task_id")
    return joined.groupBy(F.col("task_category").alias("category"), "config").agg(F.count("*").alias("n"))


@query("SELECT c.config, b.id AS task_id FROM benchmark_seed b CROSS JOIN run_configs c WHERE b.split = 'test'")
def planned_runs(spark, d):
    configs = F.broadcast(table(spark, d, "run_configs").select("config"))  # a fixed table of 12 rows
    return table(spark, d, "benchmark_seed").where("split = 'test'").select(F.col("id").alias("task_id")).crossJoin(configs).select("config", "task_id")


@query(
    "SELECT task_id FROM eval_results WHERE config = 'mini3-rag' AND task_id IS NOT NULL INTERSECT SELECT task_id FROM eval_results WHERE config = 'mid7-rag' AND task_id IS NOT NULL"
)
def common_tasks(spark, d):
    rows = table(spark, d, "eval_results").where("task_id IS NOT NULL")
    return rows.where("config = 'mini3-rag'").select("task_id").intersect(rows.where("config = 'mid7-rag'").select("task_id"))


@query("SELECT id FROM benchmark_seed EXCEPT SELECT task_id FROM eval_results")
def unanswered_tasks(spark, d):
    return table(spark, d, "benchmark_seed").select("id").exceptAll(table(spark, d, "eval_results").select(F.col("task_id").alias("id")).distinct()).distinct()


@query(f"WITH {_SCORES} SELECT task AS task_id, count(*) AS configs FROM sc GROUP BY 1 HAVING count(*) >= 3")
def well_covered_tasks(spark, d):
    scores = evaluation.task_scores(table(spark, d, "eval_results"))
    return scores.groupBy(F.col("task").alias("task_id")).agg(F.count("*").alias("configs")).where("configs >= 3")


@query(
    """SELECT category, config, mean_score FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY mean_score DESC, config) AS r FROM (
       SELECT category, config, round(avg(score), 6) AS mean_score FROM eval_results WHERE score > 0 GROUP BY ALL)) WHERE r = 1"""
)
def best_config(spark, d):
    means = evaluation.scored(table(spark, d, "eval_results")).groupBy("category", "config").agg(F.round(F.avg("score"), 6).alias("mean_score"))
    best = means.groupBy("category").agg(F.min_by(F.struct("config", "mean_score"), F.struct(-F.col("mean_score"), "config")).alias("b"))
    return best.select("category", "b.config", "b.mean_score")


@query(f"SELECT result_id FROM eval_results WHERE score > 0 ORDER BY {_ORDER.format('result_id')}, result_id LIMIT 118")
def second_judge_sample(spark, d):
    key = F.col("result_id")
    return evaluation.scored(table(spark, d, "eval_results")).orderBy(text.hash_order(42, key.cast("string")), key).limit(118).select("result_id")


@query("SELECT coalesce(retrieval, 'none') AS retrieval, e.use_rag, count(*) AS n, round(avg(e.num_chunks_retrieved), 6) AS mean_chunks FROM eval_results e JOIN run_configs USING (config) GROUP BY ALL")
def chunks_by_retrieval(spark, d):
    configs = F.broadcast(table(spark, d, "run_configs").select("config", "retrieval"))  # a fixed table of 12 rows
    joined = table(spark, d, "eval_results").select("config", "use_rag", "num_chunks_retrieved").join(configs, "config")
    return joined.groupBy(F.coalesce("retrieval", F.lit("none")).alias("retrieval"), "use_rag").agg(
        F.count("*").alias("n"), F.round(F.avg("num_chunks_retrieved"), 6).alias("mean_chunks")
    )


# -- ingest: specifications and collections made from the tables -----------------------------------------------------

_BODY = '{"type": "object", "properties": {"id": {"type": "integer", "format": "int64"}, "tags": {"type": "array", "items": {"$ref": "#/definitions/Tag"}}}, "required": ["id"]}'
_PARAMETERS = """[{"$ref": "#/parameters/hotel"}, {"$ref": "#/parameters/none"}, {"name": "limit", "in": "query", "schema": {"type": "integer"}},
    {"name": "x-app-key", "in": "header"}, {"name": "b", "in": "body", "schema": {"$ref": "#/definitions/Body"}}]"""
_RESPONSES = '{"200": {"schema": {}}, "201": {"schema": {"allOf": [{"type": "object"}, {"$ref": "#/definitions/Tag"}, {"$ref": "#/definitions/None"}]}}, "404": {}, "400": {}}'
_SPEC_REST = f'"parameters": {{"hotel": {{"name": "hotelId", "in": "path", "required": true, "description": "the house"}}}}, "definitions": {{"Body": {_BODY}, "Tag": {{"type": "string", "enum": ["A"]}}}}'


def _quoted(c: str) -> Column:
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def _specs(spark, d) -> DataFrame:
    """One specification a source file from its calls: (spec, text)."""
    calls = table(spark, d, "all_postman_chunks").where("method <> '' AND path <> '' AND source_file IS NOT NULL").groupBy("source_file", "path", F.lower("method").alias("method"))
    entry = F.concat(
        _quoted("method"), F.lit(': {"operationId": "op", "summary": '), _quoted("summary"), F.lit(', "description": '), _quoted("html"), F.lit(', "tags": ["t", "u"], "parameters": '),
        F.lit(_PARAMETERS), F.lit(', "responses": '), F.lit(_RESPONSES), F.lit("}"),
    )
    entries = calls.agg(F.min("section").alias("summary")).withColumn("html", F.concat(F.lit("<b>"), F.coalesce("summary", F.lit("")), F.lit("</b>"))).select("source_file", "path", entry.alias("e"))
    of_path = entries.groupBy("source_file", "path").agg(F.concat(_quoted("path"), F.lit(': {"x-note": {}, '), F.array_join(F.collect_list("e"), ", "), F.lit("}")).alias("p"))
    whole = F.concat(F.lit('{"basePath": "/api", "paths": {'), F.array_join(F.collect_list("p"), ", "), F.lit("}, "), F.lit(_SPEC_REST), F.lit("}"))
    return of_path.groupBy(F.col("source_file").alias("spec")).agg(whole.alias("text"))


_TOLD_BODY = """{
  "type": "object",
  "properties": {
    "id": {
      "type": "integer",
      "format": "int64"
    },
    "tags": {
      "type": "array",
      "items": "..."
    }
  },
  "required": [
    "id"
  ]
}"""
_TOLD_RESPONSE = """{
  "type": "string",
  "enum": [
    "A"
  ]
}"""


@query(
    f"""SELECT spec, substring(md5(spec || ':' || m || ':' || path), 1, 12) AS endpoint_id, upper(m) AS method, '/api' || path AS path, 'multi' AS module, 'sync' AS kind,
        md5(upper(m) || ' /api' || path || chr(10) || 'Operation: op' || chr(10) || 'Summary: ' || s || CASE WHEN s <> '' AND {_strip("s")} <> s THEN chr(10) || 'Description: ' || {_strip("s")} ELSE '' END
            || chr(10) || 'Tags: t, u' || chr(10) || 'Parameters:' || chr(10) || '  - hotelId (path, string, required): the house' || chr(10) || '  - limit (query, integer, optional): '
            || chr(10) || 'Request Body: {_TOLD_BODY}' || chr(10) || 'Response Schema: {_TOLD_RESPONSE}' || chr(10) || 'Error Codes: 400, 404') AS digest
        FROM (SELECT source_file AS spec, path, lower(method) AS m, coalesce(min(section), '') AS s FROM all_postman_chunks WHERE method <> '' AND path <> '' AND source_file IS NOT NULL GROUP BY ALL)"""
)
def spec_endpoints(spark, d):
    """Specifications read back into endpoints: references, headers, body, responses and texts."""
    ship(spark)
    rows = ingest.spec_endpoints(_specs(spark, d))
    return rows.select("spec", "endpoint_id", "method", "path", ingest.spec_module(F.col("spec")).alias("module"), ingest.spec_type(F.col("spec")).alias("kind"), F.md5(ingest.endpoint_text()).alias("digest"))


def _item(name: str) -> Column:
    """A request of a collection: its path in segments, one enabled and one disabled query parameter, a body."""
    return F.struct(
        F.col(name).alias("name"),
        F.struct(
            "method",
            F.struct(
                F.filter(F.split("path", "/"), lambda s, i: i > 0).alias("path"),
                F.array(
                    F.struct(F.lit("limit").alias("key"), F.col("row_no").cast("string").alias("value"), F.lit(False).alias("disabled")),
                    F.struct(F.lit("off").alias("key"), F.lit("1").alias("value"), F.lit(True).alias("disabled")),
                ).alias("query"),
            ).alias("url"),
            F.struct(F.col("text").alias("raw")).alias("body"),
        ).alias("request"),
    )


def _collections(spark, d, folder: str, name: str) -> DataFrame:
    """One collection a source file: its requests by ``folder``, in the order of row_no, under the second top-level folder."""
    rows = table(spark, d, "all_postman_chunks").where("method <> '' AND startswith(path, '/') AND source_file IS NOT NULL AND text IS NOT NULL").withColumn(name, F.coalesce(name, F.lit("")))
    ordered = rows.groupBy("source_file", F.coalesce(folder, F.lit("none")).alias("folder")).agg(F.array_sort(F.collect_list(F.struct("row_no", _item(name).alias("i")))).alias("rows"))
    folders = ordered.groupBy("source_file").agg(
        F.array_sort(F.collect_list(F.struct(F.col("folder").alias("name"), F.transform("rows", lambda r: r["i"]).alias("item")))).alias("item")
    )
    return folders.select("source_file", F.concat(F.lit('{"item": [{}, '), F.to_json(F.struct("item")), F.lit("]}")).alias("text"))


_CALLS = "all_postman_chunks WHERE method <> '' AND starts_with(path, '/') AND source_file IS NOT NULL AND text IS NOT NULL"
_SAMPLE = _strip("text")


@query(
    f"""SELECT source_file, position, 'pm-' || substring(md5(method || path || s), 1, 10) AS id, CASE f WHEN 'crm' THEN 'customers' ELSE 'multi' END AS module,
        CASE WHEN s = '' THEN f ELSE f || '/' || s END AS section, method, path, md5('Postman Example: ' || s || chr(10) || 'Module: ' || f || chr(10) || method || ' ' || path || chr(10) || 'Query parameters: limit=' || row_no
            || CASE WHEN {_SAMPLE} = '' THEN '' ELSE chr(10) || 'Sample request body:' || chr(10)
               || CASE WHEN length({_SAMPLE}) <= 2000 THEN {_SAMPLE} ELSE substring({_SAMPLE}, 1, 2000) || chr(10) || '... (truncated)' END END) AS digest
        FROM (SELECT *, (row_number() OVER (PARTITION BY source_file ORDER BY f, row_no) - 1)::INT AS position
              FROM (SELECT *, coalesce(module, 'none') AS f, coalesce(section, '') AS s FROM {_CALLS}))"""
)
def request_collections(spark, d):
    """Collections read back into requests, in the order of their tree."""
    ship(spark)
    rows = ingest.request_rows(_collections(spark, d, "module", "section"), {"crm": "customers"})
    return rows.select("source_file", "position", "id", "module", "section", "method", "path", F.md5("text").alias("digest"))


_STEP = f"""'Step ' || i || ': ' || s || chr(10) || '  ' || method || ' ' || path || chr(10) || {{0}} || CASE WHEN {{1}} = '' THEN '' ELSE '  Body:' || chr(10) || {{1}} || chr(10) END"""
_WHOLE_BODY = _strip(f"substring({_SAMPLE}, 1, 800)")
_HALF_BODY = _strip("substring(text, 1, 600)")


@query(
    f"""WITH st AS (SELECT source_file, coalesce(section, 'none') AS f, coalesce(module, '') AS s, method, path, text, row_no,
            row_number() OVER (PARTITION BY source_file, coalesce(section, 'none') ORDER BY row_no) AS i, count(*) OVER (PARTITION BY source_file, coalesce(section, 'none')) AS n FROM {_CALLS}),
    w AS (SELECT source_file, f, any_value(n) AS n, string_agg({_STEP.format("'  Query: limit=' || row_no || chr(10)", _WHOLE_BODY)}, chr(10) ORDER BY i) AS whole,
            coalesce(string_agg({_STEP.format("''", _HALF_BODY)}, chr(10) ORDER BY i) FILTER (i <= n // 2), '') AS first, string_agg({_STEP.format("''", _HALF_BODY)}, chr(10) ORDER BY i) FILTER (i > n // 2) AS second FROM st GROUP BY 1, 2),
    p AS (SELECT source_file, f, n, unnest(CASE WHEN length('Workflow: ' || f || chr(10) || 'Steps: ' || n || chr(10) || chr(10) || whole) > 6000 THEN [1, 2] ELSE [0] END) AS k, whole, first, second FROM w)
    SELECT source_file, CASE k WHEN 0 THEN f ELSE f || ' (Part ' || k || '/2)' END AS section, 'wf-' || substring(md5(CASE k WHEN 0 THEN f ELSE f || '-part' || (k - 1) END), 1, 10) AS id,
        md5(CASE k WHEN 0 THEN 'Workflow: ' || f || chr(10) || 'Steps: ' || n || chr(10) || chr(10) || whole
            ELSE 'Workflow: ' || f || ' (Part ' || k || '/2)' || chr(10) || 'Total steps: ' || n || chr(10) || chr(10) || CASE k WHEN 1 THEN first ELSE second END END) AS digest FROM p"""
)
def workflow_collections(spark, d):
    """Workflow collections read back into texts, the long ones in two halves."""
    ship(spark)
    rows = ingest.workflow_rows(_collections(spark, d, "section", "module"), {})
    return ingest.workflow_texts(rows).select("source_file", "section", "id", F.md5("text").alias("digest"))


@query(
    f"""WITH st AS (SELECT source_file, coalesce(section, 'none') AS f, coalesce(module, '') AS s, method || ' ' || path AS call, row_number() OVER (PARTITION BY source_file, coalesce(section, 'none') ORDER BY row_no) AS i FROM {_CALLS}),
    w AS (SELECT source_file || '|' || f AS key, count(DISTINCT call) AS calls, string_agg(i || '. ' || s || ': ' || call, chr(10) ORDER BY i) AS told FROM st WHERE NOT starts_with(f, 'Search') GROUP BY ALL)
    SELECT 'wf-orch-' || CASE WHEN r < 1000 THEN lpad(r::VARCHAR, 3, '0') ELSE r::VARCHAR END AS id, key, CASE WHEN calls <= 3 THEN 'basic' WHEN calls <= 6 THEN 'intermediate' ELSE 'advanced' END AS difficulty,
        md5('The required API sequence is:' || chr(10) || told) AS digest FROM (SELECT *, row_number() OVER (ORDER BY key) AS r FROM w)"""
)
def workflow_tasks(spark, d):
    """Evaluation tasks made from workflows."""
    ship(spark)
    rows = ingest.workflow_rows(_collections(spark, d, "section", "module"), {}).withColumn("key", F.concat_ws("|", "source_file", "name"))
    return training.workflow_tasks(rows, "key", ("Search",)).select("id", "key", "difficulty", F.md5("expected_answer").alias("digest"))

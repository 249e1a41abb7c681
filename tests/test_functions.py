"""Expressions and operators against hand-computed values and plain Python."""

from __future__ import annotations

import hashlib
import json
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skarn import queries
from skarn.functions import paths, text
from skarn.operators import corpus, curation, evaluation, ingest, retrieval, training
from skarn.plans import plugins
from skarn.plans.skew import salted_join
from skarn.sources import formats
from skarn.streaming.incremental import index_stream, unjudged
from tests.compare import compare, connect


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column).first()[0]


def test_clean_text_drops_short_lines_that_start_without_a_letter(spark):
    assert one(spark, text.clean_text(F.col("t")), t="a\n\n\n\nb \t c\n12\n1234\n é \n") == "a\n\nb c\n1234\n é"


@pytest.mark.parametrize("source", ["getProfileByExtId", "HTMLParser x_1", "word", "ABcDEf 12a", "", "ÉtéFoo"])
def test_tokens_equal_python(spark, source):
    assert one(spark, text.tokens(F.col("t")), t=source) == retrieval.tokenise(source)


def test_lower_case_words_come_twice(spark):
    assert one(spark, text.tokens(F.col("t")), t="word") == ["word", "word"]


def test_paths(spark):
    answer = "Use POST `/rsv/v1/hotels/{{HotelId}}/x/`. Then GET /a/{b}, and /2 or and/or; /rsv/v1/hotels/{id}/x."
    assert one(spark, paths.extract(F.col("t")), t=answer) == ["/rsv/v1/hotels/{}/x", "/a/{}"]


def test_subqueries_repeat_a_question_that_does_not_split(spark):
    q = "How do I change the arrival date of a stay?"
    assert one(spark, text.subqueries(F.col("t")), t=q) == [q, q]
    assert one(spark, text.subqueries(F.col("t"), distinct=True), t=q) == [q]


def test_overlap_chunks():
    assert ingest.overlap_chunks(" " * 4000) == [" " * 4000]
    assert [len(c) for c in ingest.overlap_chunks("x" * 4001)] == [4000, 201]
    assert [len(c) for c in ingest.overlap_chunks("x" * 7700)] == [4000, 3900, 100]
    late = "a" * 3000 + "\n\n" + "b" * 3000
    assert ingest.overlap_chunks(late)[0] == "a" * 3000
    early = "a" * 1000 + "\n\n" + "b" * 5000
    assert len(ingest.overlap_chunks(early)[0]) == 4000
    assert ingest.overlap_chunks(None) == []


def test_markdown_sections(spark):
    rows = [(1, "# A\nx\n## B\ny\n### C\nz"), (2, "no heading"), (3, ""), (4, None)]
    got = ingest.markdown_sections(spark.createDataFrame(rows, "k int, text string"), "k").collect()
    assert [(r.k, r.level, r.title, r.body) for r in sorted(got, key=lambda r: (r.k, r.section_no))] == [
        (1, 1, "A", "x"), (1, 2, "B", "y\n### C\nz"), (2, 0, "", "no heading"),
    ]


def test_toc_sections(spark):
    toc = spark.createDataFrame(
        [("f", 0, 1, "Contents", 1), ("f", 1, 1, "One", 2), ("f", 2, 2, "Sub", 3), ("f", 3, 3, "Deep", 3), ("f", 4, 1, "Two", 4), ("f", 5, 2, "Same", 4)],
        "file string, position int, level int, title string, page int",
    )
    pages = spark.createDataFrame([("f", p, f"page {p} text") for p in range(1, 6)], "file string, page int, text string")
    got = {r.title: r.text for r in ingest.toc_sections(toc, pages).collect()}
    assert got["One"] == "page 2 text\npage 3 text" and got["Sub"] == "page 3 text" and got["Two"].endswith("page 5 text")
    short = {r.title: r.text for r in ingest.toc_sections(toc, pages, keep_last_page=False).collect()}
    assert short["Two"] == "page 4 text"
    assert ingest.page_groups(pages, 3).count() == 2


def test_spec_endpoints(spark):
    spec = {
        "basePath": "/rsv/v1",
        "parameters": {"p": {"name": "hotel", "in": "path", "required": True}},
        "definitions": {"A": {"type": "object", "properties": {"x": {"$ref": "#/definitions/B"}}}, "B": {"type": "array", "items": {"type": "string", "maxLength": 3}}},
        "paths": {
            "/stays": {
                "x-note": {},
                "post": {
                    "operationId": "postStays", "summary": "Create", "tags": ["t"],
                    "parameters": [{"$ref": "#/parameters/p"}, {"name": "authorization", "in": "header"}, {"in": "body", "schema": {"allOf": [{"$ref": "#/definitions/A"}, {"$ref": "#/definitions/Z"}]}}],
                    "responses": {"200": {"description": "ok"}, "201": {"schema": {"type": "string"}}, "404": {}, "400": {}},
                },
            }
        },
    }
    rows = spark.createDataFrame([("s", json.dumps(spec)), ("bad", "{"), ("none", None)], "spec string, text string")
    (r,) = ingest.spec_endpoints(rows).collect()
    assert (r.method, r.path, r.error_codes) == ("POST", "/rsv/v1/stays", ["400", "404"])
    assert [(p.name, p.required, p.type) for p in r.parameters] == [("hotel", True, "string")]
    assert json.loads(r.body_schema) == {"type": "object", "properties": {"x": {"type": "array", "items": "..."}}}
    assert json.loads(r.response_schema) == {"type": "string"}
    told = ingest.spec_endpoints(rows).select(ingest.endpoint_text()).first()[0]
    assert told.startswith("POST /rsv/v1/stays\nOperation: postStays\nSummary: Create\nTags: t\nParameters:\n  - hotel (path, string, required): \nRequest Body: {")
    assert told.endswith('Response Schema: {\n  "type": "string"\n}\nError Codes: 400, 404')
    assert ingest.simplify_schema({"$ref": "#/definitions/Nope"}, spec) == "$Nope (unresolved)"


def test_schemas():
    root = {"definitions": {"Loop": {"type": "object", "properties": {"next": {"$ref": "#/definitions/Loop"}}}, "S": {"type": "string"}}}
    loop = ingest.simplify_schema({"$ref": "#/definitions/Loop"}, root)
    assert loop == {"type": "object", "properties": {"next": {"type": "object", "properties": {"next": "..."}}}}
    merged = ingest.simplify_schema({"allOf": [{"allOf": [{"type": "integer", "minimum": 1}, {"format": "x"}]}, {"$ref": "#/definitions/S"}, {"$ref": "#/definitions/Z"}]}, root)
    assert merged == {"type": "string", "minimum": 1, "format": "x"} and list(merged) == ["type", "minimum", "format"]
    assert ingest.simplify_schema("x", root) == "x" and ingest.simplify_schema({}, root) == "unknown" and ingest.simplify_schema({"type": "object", "required": []}, root) == {"type": "object"}


def test_specification_corners():
    spec = {"paths": {"/a": {"get": {"description": "<p>A <b>b</b></p>", "parameters": [{"$ref": "#/parameters/gone"}, {"name": "n", "in": "query", "schema": {"type": "integer"}}], "responses": {"200": {"schema": {}}, "201": {"schema": {"type": "string"}}}}, "x": 1}}}
    (row,) = ingest.Specification("s", spec).rows()
    assert [(p["name"], p["type"]) for p in row["parameters"]] == [("n", "integer")] and row["description"] == "A  b" and json.loads(row["response_schema"]) == {"type": "string"}
    assert row["endpoint_id"] == hashlib.md5(b"s:get:/a").hexdigest()[:12]


def test_overlap_chunks_by_brute_force():
    import random

    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("ab \n\n") for _ in range(rng.randrange(0, 200)))
        size, overlap = rng.randrange(10, 60), rng.randrange(0, 5)
        want, at = ([text] if len(text) <= size else []), 0
        while len(text) > size and at < len(text):
            end = at + size
            ends = [k for k in range(at + size // 2, end - 1) if text[k : k + 2] == "\n\n"] if end < len(text) else []
            end = ends[-1] if ends else end
            want.append(text[at:end].strip())
            at = end - overlap
        assert ingest.overlap_chunks(text, size, overlap) == want


def test_request_rows(spark):
    item = {"name": "A", "item": [{"name": "call", "request": {"method": "GET", "url": {"path": ["v1", "x"], "query": [{"key": "a", "value": "1"}, {"key": "b", "disabled": True}]}, "body": {"raw": "y" * 2100}}}]}
    plain_url = {"name": "plain", "request": {"method": "PUT", "url": "http://h"}}
    tree = json.dumps({"item": [{"name": "skip", "item": []}, {"name": "use", "item": [item, plain_url]}]})
    got = ingest.request_rows(spark.createDataFrame([("f", tree), ("bad", "[]")], "source_file string, text string"), {"A": "crm"}).orderBy("position").collect()
    assert [(r.section, r.method, r.path, r.module) for r in got] == [("A/call", "GET", "/v1/x", "crm"), ("plain", "PUT", "http://h", "multi")]
    assert got[0].text.startswith("Postman Example: call\nModule: A\nGET /v1/x\nQuery parameters: a=1\n") and got[0].text.endswith("... (truncated)")


def test_workflow_texts(spark):
    step = ("s", "GET", "/p", ["a=1"], "b" * 900)
    schema = "name string, steps array<struct<name:string,method:string,path:string,query:array<string>,body:string>>"
    rows = spark.createDataFrame([("short", [step]), ("long", [step] * 10)], schema)
    got = {(r["name"], r.part): r.text for r in ingest.workflow_texts(rows).collect()}
    assert set(got) == {("short", 0), ("long", 0), ("long", 1)}
    assert got["short", 0].startswith("Workflow: short\nSteps: 1\n\nStep 1: s\n  GET /p\n  Query: a=1\n  Body:\n")
    assert got["long", 1].startswith("Workflow: long (Part 2/2)\nTotal steps: 10\n\nStep 6:") and "Query" not in got["long", 0]


def test_global_position_and_ids(spark):
    df = spark.createDataFrame([(n, "a" if n % 3 else f"b{n}") for n in range(50)], "row_no long, id string")
    got = corpus.dedup_ids(df, "id", ["row_no"]).orderBy("row_no").collect()
    assert [r.position for r in got] == list(range(50))
    assert got[1].unique_id == "a" and got[2].unique_id == "a_2" and len({r.unique_id for r in got}) == 50


def test_split_rounds_half_to_even(spark):
    df = spark.createDataFrame([(f"{s}-{n}", s) for s in (1, 5, 15, 35) for n in range(s)], "id string, stratum int")
    got = curation.stratified_split(df, ["stratum"], "id").where("subset = 'test'").groupBy("stratum").count().collect()
    assert {r.stratum: r["count"] for r in got} == {1: 1, 5: 2, 15: 4, 35: 10}


def test_salted_join_equals_join(spark):
    left = spark.createDataFrame([(n, "hot" if n % 3 else f"k{n % 7}") for n in range(300)] + [(999, None)], "n int, key string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "key string, v int")
    for how in ("inner", "left", "left_semi"):
        want = left.join(right, "key", how)
        got = salted_join(left, right, "key", how, "n", hot_rows=50, salt_rows=20)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_tails(spark):
    def tail(column):
        return spark.range(1).select(column).first()[0]

    lit = lambda x: F.lit(x)
    for x, df in ((3.841459, 1), (5.991465, 2), (18.307038, 10), (19.675138, 11)):
        assert math.isclose(tail(evaluation.chi_square_tail(lit(x), lit(df))), 0.05, abs_tol=1e-6)
    assert math.isclose(tail(evaluation.normal_two_sided(lit(-1.959964))), 0.05, abs_tol=1e-6)
    assert tail(evaluation.normal_two_sided(lit(None).cast("double"))) is None and tail(evaluation.chi_square_tail(lit(0.0), lit(3))) == 1.0
    for r, n in ((0.6319, 10), (0.361, 30), (0.0620, 1000)):  # critical values at five per cent
        assert math.isclose(tail(evaluation.correlation_p(lit(r), lit(n))), 0.05, abs_tol=2e-4)


def test_build_set(spark):
    chunk = lambda t: (t, "f", "s", 0.5, False)
    path = "/rsv/v1/stays"
    rows = [
        (1, "c", "m", "how?", f"Use {path}.", f"the source of {path}", [chunk("a"), chunk("b"), chunk("c"), chunk("d"), chunk("e")]),
        (2, "c", "m", "how?", f"Use {path}.", None, [chunk(f"{path} is here")]), (3, "c", None, "how?", "Use /crm/v9/gone.", None, [chunk("x")]), (4, "d", "m", "why?", "So.", "x", [chunk("x")]),
    ]
    schema = "query_id long, category string, module string, question string, gold_answer string, source_text string, chunks array<struct<text:string,source_file:string,section:string,distance:double,protected:boolean>>"
    lookup = spark.createDataFrame([(path, "text of it")], "path string, text string")
    got = {r.query_id: r for r in training.build_set(spark.createDataFrame(rows, schema), lookup, "sys").collect()}
    assert set(got) == {1, 2, 4} and sum(r.subset == "val" for r in got.values()) == 1
    assert [m.role for m in got[1].messages] == ["system", "user", "assistant"] and "the source of" in got[1].messages[1].content and "]\ne" not in got[1].messages[1].content
    assert got[4].messages[1].content.count("[Source") == 1


def test_config_resolution(spark):
    configs = spark.createDataFrame([("a", 5), ("b", None)], "config string, top_k int")
    assert training.resolve_config(configs, "a", top_k=9) == {"config": "a", "top_k": 9}
    for bad in (lambda: training.resolve_config(configs, "z"), lambda: training.resolve_config(configs, "a", nothing=1)):
        with pytest.raises(KeyError):
            bad()


def test_sinks(spark, tmp_path):
    from skarn.sources import formats

    df = spark.createDataFrame([("1", "2.0"), ("2", ""), ("3", "x")], "id string, v string")
    formats.review_sheet(df, f"{tmp_path}/sheet")
    assert formats.read_csv(spark, f"{tmp_path}/sheet").columns == ["id", "v", "verdict", "notes"]
    formats.write_summary(df.groupBy().count(), f"{tmp_path}/summary")
    assert spark.read.json(f"{tmp_path}/summary").first()["count"] == 3
    assert [r[0] for r in df.orderBy("id").select(formats.int_cell(F.col("v"))).collect()] == [2, None, None]
    (tmp_path / "a.md").write_text("# A")
    rows = formats.read_registry(spark, [(f"{tmp_path}/a.md", "crm", "guide"), (f"{tmp_path}/gone.md", "crm", "guide")]).collect()
    assert [(r.source_file, r.text, r.module) for r in rows] == [("a.md", "# A", "crm")]
    index = corpus.write_index(spark.createDataFrame([(1, "alpha beta")], "doc_id long, text string"), f"{tmp_path}/index")
    asked = spark.createDataFrame([(7, "alpha")], "query_id long, question string")
    assert retrieval.retrieve("dense", asked, index, 1).first().doc_id == 1
    with pytest.raises(KeyError):
        retrieval.retrieve("unknown", asked, index)


def test_bm25_against_plain_python(spark):
    docs = [(1, "alpha beta beta"), (2, "beta gamma"), (3, "delta"), (4, "alpha Alpha alpha delta epsilon")]
    got = retrieval.bm25_topk(spark.createDataFrame([(9, "alpha beta alpha")], "query_id long, question string"), spark.createDataFrame(docs, "doc_id long, text string"), 4)
    tokens = {i: retrieval.tokenise(t) for i, t in docs}
    n, mean = len(docs), np.mean([len(t) for t in tokens.values()])
    df = {t: sum(t in x for x in tokens.values()) for x in tokens.values() for t in x}
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    low = 0.25 * np.mean(list(idf.values()))
    score = {i: sum((idf[q] if idf[q] >= 0 else low) * t.count(q) * 2.5 / (t.count(q) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for q in retrieval.tokenise("alpha beta alpha")) for i, t in tokens.items()}
    want = sorted(score, key=lambda i: (-round(score[i], 6), i))
    assert [r.doc_id for r in got.orderBy("rank").collect()] == want


def test_dense_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)], f"m{i % 2}") for i in range(60)]
    corpus_df = spark.createDataFrame(rows, "doc_id long, vector array<double>, module string")
    queries = corpus_df.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    for with_filter in (False, True):
        got = {(r.query_id, r["rank"]): r.doc_id for r in retrieval.dense_topk(queries, corpus_df, 3, with_filter).collect()}
        for q, v, m in rows[::20]:
            unit = lambda x: np.array(x) / np.linalg.norm(x)
            order = sorted((-round(float(unit(v) @ unit(w)), 6), i) for i, w, mm in rows if i != q and (mm == m or not with_filter))
            assert [got[q, k + 1] for k in range(3)] == [i for _, i in order[:3]]


def test_empty_query_set(spark):
    empty = spark.createDataFrame([], "query_id long, question string")
    assert retrieval.text_topk(empty, spark.createDataFrame([(1, "x")], "doc_id long, text string")).count() == 0


def test_prompt_and_judge(spark):
    chunk = training.CHUNK_TYPE
    df = spark.createDataFrame([("q", [("t1", "f", "s", 0.1, False), ("t2", None, None, 0.2, False)]), ("q", [])], f"q string, c array<{chunk}>")
    got = [r[0] for r in df.select(training.user_prompt(F.col("q"), F.col("c"))).collect()]
    assert got == ["Context:\n[Source 1: f — s]\nt1\n\n---\n\n[Source 2:  — ]\nt2\n\nQuestion: q", "q"]
    for reply, score in (('{"score": 4, "reason": "x"}', 4), ('```json\n{"score": 2, "reason": "y"}\n```', 2), ("no", -1)):
        assert one(spark, training.parse_judgement(F.col("r"))["score"], r=reply) == score


def test_answer_template(spark):
    df = spark.createDataFrame([("GET", "/p", "getP", "Gets it.  OperationId: x", ["a", "b"])], "m string, p string, o string, d string, r array<string>")
    got = df.select(training.call_answer(*[F.col(c) for c in "mpodr"])).first()[0]
    assert got == "`GET /p` (operationId `getP`). Gets it. Required parameters: a, b."


def test_trim_skips_what_does_not_fit(spark):
    texts = [("a" * 50, 0.1, False), ("b" * 90, 0.2, False), ("c" * 30, 0.3, False), ("d" * 40, 0.9, True)]
    chunks = [(t, "f", "s", dist, p) for t, dist, p in texts]
    df = spark.createDataFrame([(1, "q", "gold", chunks)], f"query_id int, question string, gold_answer string, chunks array<{training.CHUNK_TYPE}>")
    got = training.trim(df, budget=200 + 5 + 130).first()
    assert [c.text[0] for c in got.chunks] == ["a", "c", "d"] and got.grounded_after_trim
    tight = training.trim(df, budget=200 + 5 + 20).first()
    assert [len(c.text) for c in tight.chunks] == [20]


def test_grounding_injects_missing_paths(spark):
    df = spark.createDataFrame(
        [(1, "q", "Use /rsv/v1/stays.", [("x", "f", "s", 0.1, False)] * 5), (2, "q", "Use /zzz/v1/none.", [("x", "f", "s", 0.1, False)])],
        f"query_id int, question string, gold_answer string, chunks array<{training.CHUNK_TYPE}>",
    )
    lookup = spark.createDataFrame([("/rsv/v1/stays", "call /rsv/v1/stays now")], "path string, text string")
    got = {r.query_id: r for r in training.ground(df, lookup).collect()}
    assert got[1].grounded and len(got[1].chunks) == 5 and sum(c.protected for c in got[1].chunks) == 1
    assert not got[2].grounded and len(got[2].chunks) == 1


def test_claims(spark):
    tasks = spark.createDataFrame(
        [("a", "api_orchestration", "Send GET /rsv/v1/stays/{x} and getStays1"), ("b", "config_advisory", "Set Late Fee Window."), ("c", "x", "POST /no/v1/where"), ("d", "x", None)],
        "id string, category string, expected_answer string",
    )
    methods = spark.createDataFrame([("/rsv/v1/stays/{}", ["POST"])], "path string, methods array<string>")
    known = spark.createDataFrame([("set late fee window",)], "phrase string")
    got = {r.id: (r.verdict, r.findings) for r in curation.verify_claims(tasks, methods, known, spark.createDataFrame([("x",)], "operation string")).collect()}
    assert got["a"][0] == "CHECK" and "METHOD MISMATCH" in got["a"][1] and "getStays1" in got["a"][1]
    assert got["b"] == ("CLEAN", "") and "PATH NOT IN CORPUS: POST /no/v1/where" in got["c"][1] and got["d"][0] == "CLEAN"


def test_friedman_ranks_complete_tasks_by_category(spark, tmp_path):
    rows = [(f"{c}{t}", config, c, (t + n) % 5 + 1) for c, size in (("a", 4), ("b", 2)) for t in range(size) for n, config in enumerate("xyz")]
    rows += [("a9", "x", "a", 5), ("a0", "x", None, 1), ("a1", "y", "a", -1)]
    spark.createDataFrame(rows, "task_id string, config string, category string, score int").write.parquet(f"{tmp_path}/eval_results.parquet")
    got = queries.QUERIES["friedman_ranks"](spark, str(tmp_path))
    mine, theirs, only_mine, only_theirs = compare(got, queries.SQL["friedman_ranks"], connect(str(tmp_path)))
    assert (mine, only_mine, only_theirs) == (theirs, [], [])
    assert {(r.category, r.tasks) for r in got.collect()} == {("a", 4), ("ALL", 6)}
    scores = evaluation.task_scores(spark.read.parquet(f"{tmp_path}/eval_results.parquet")).toPandas().pivot(index="task", columns="config", values="score").dropna()
    ranks = scores.rank(axis=1, ascending=False)
    n, k = ranks.shape
    tie = sum(int(c) ** 3 - int(c) for _, row in scores.iterrows() for c in row.value_counts())
    chi = (12 / (n * k * (k + 1)) * float((ranks.sum() ** 2).sum()) - 3 * n * (k + 1)) / (1 - tie / (n * k * (k * k - 1)))
    every = {r.config: r for r in got.collect() if r.category == "ALL"}
    assert all(abs(every[c].mean_rank - ranks[c].mean()) < 1e-6 and abs(every[c].chi_square - chi) < 1e-5 for c in "xyz")


def test_bootstrap_draws_ten_thousand_resamples_like_brute_force(spark):
    values = {"a": [1.0, 2.0, 2.0, 3.5, 5.0, 5.0, 4.0], "b": [0.0, 0.0, 0.0, 1.0], "c": [2.0]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("a", None)], "g string, v double")
    means = evaluation.resampled_means(df, "g", "v").toPandas()
    rng = np.random.default_rng(1)
    for r in evaluation.bootstrap(df, "g", "v").collect():
        own, drawn = np.array(values[r.g]), means[means["g"] == r.g]
        assert r.n == len(own) and sorted(drawn["rep"]) == list(range(10_000))
        brute = own[rng.integers(0, len(own), (10_000, len(own)))].mean(axis=1)
        assert abs(drawn["m"].mean() - brute.mean()) < 0.05 and abs(drawn["m"].std() - brute.std()) < 0.03
        assert np.allclose([r.ci_low, r.ci_high], np.percentile(drawn["m"], [2.5, 97.5]), atol=1e-6)
        assert np.allclose([r.ci_low, r.ci_high], np.percentile(brute, [2.5, 97.5]), atol=0.08)
    assert evaluation.bootstrap(df, "g", "v").collect() == evaluation.bootstrap(df.repartition(5), "g", "v").collect()


def test_control_phrases_are_looked_up_as_substrings_of_every_text(spark):
    said = "See In Setup. Late Fee Window. Rate Plan Code. Fee Window Late. No Such Phrase."
    tasks = spark.createDataFrame([("a", "config_advisory", said), ("b", "x", said)], "id string, category string, expected_answer string")
    methods = spark.createDataFrame([("/rsv/v1/stays/{}", ["POST"])], "path string, methods array<string>")
    texts = spark.createDataFrame([("login setup; open the late fee windows",), ("the new rate plan code list entry",), (None,), ("see in setup",)], "text string")
    none = spark.createDataFrame([("x",)], "operation string")
    got = {r.id: r.findings for r in curation.verify_claims(tasks, methods, texts, none).collect()}
    missing = [f"CONTROL/SETTING NOT FOUND IN DOCS: '{p}'" for p in ("Fee Window Late", "No Such Phrase")]
    assert got == {"a": " | ".join(missing), "b": ""}
    phrases = spark.createDataFrame([("in setup",), ("late fee window",), ("no",), ("new rate",)], "phrase string")
    assert sorted(r.phrase for r in curation.contained(phrases, texts, block_phrases=1).collect()) == ["in setup", "late fee window", "new rate"]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_claims_equal_a_search_of_all_texts(spark, size):
    folder = f"/root/testdata/{size}"
    read = lambda t, *c: spark.read.parquet(f"{folder}/{t}.parquet").select(*c).collect()
    everything = "\n".join((r.text or "").lower() for t in ("all_doc_chunks", "all_postman_chunks") for r in read(t, "text"))
    want = {
        (r.id, p)
        for r in read("benchmark_seed", "id", "category", "expected_answer")
        if r.category == "config_advisory"
        for p in re.findall(text.CAPITALISED_PHRASE, r.expected_answer or "", re.ASCII)
        if p.lower() not in everything
    }
    rows = queries.QUERIES["verify_claims"](spark, folder).collect()
    assert {(r.id, p) for r in rows for p in re.findall(r"NOT FOUND IN DOCS: '(.*?)'", r.findings)} == want


def test_plugins():
    assert plugins.plugin(plugins.EMBEDDERS, "hash").embed(["a b", ""]).shape == (2, 64)
    with pytest.raises(KeyError):
        plugins.plugin(plugins.JUDGES, "unknown")
    reply = plugins.OverlapJudge().judge(["EXPECTED ANSWER:\na b\n\nGENERATED ANSWER:\na b\n\n"])[0]
    assert json.loads(reply.strip("`").removeprefix("json"))["score"] == 5
    assert plugins.ExtractiveGenerator().generate(["Context:\n[Source 1: f — s]\nfirst line\nx"]) == ["first line"]


def test_formats_and_stream(spark, tmp_path):
    assert formats.read_jsonl(spark, [f"file://{tmp_path}/none*.jsonl"], formats.CHUNK).count() == 0
    (tmp_path / "in").mkdir()
    rows = [{"id": "1", "text": "a"}, {"id": "1", "text": "b"}, {"id": "2", "text": "c"}]
    (tmp_path / "in/x.json").write_text("\n".join(map(json.dumps, rows)))
    for _ in range(2):
        index_stream(spark, f"file://{tmp_path}/in", formats.CHUNK, f"file://{tmp_path}/index", f"file://{tmp_path}/cp").awaitTermination()
    (tmp_path / "in/y.json").write_text(json.dumps({"id": "2", "text": "again"}) + "\n" + json.dumps({"id": "3", "text": "d"}))
    index_stream(spark, f"file://{tmp_path}/in", formats.CHUNK, f"file://{tmp_path}/index", f"file://{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/index").orderBy("id").select("id", "text").collect()
    assert [(r.id, r.text) for r in got] == [("1", "a"), ("2", "c"), ("3", "d")]
    csv = spark.createDataFrame(pd.DataFrame({"id": ["1"], "q": ['two\nlines, "quoted"'], "blank": [""]}))
    formats.write_csv(csv, f"file://{tmp_path}/csv")
    assert formats.read_csv(spark, f"file://{tmp_path}/csv").first().q == 'two\nlines, "quoted"'
    assert formats.markdown_table(csv.select("id"), ["id"]) == "| id |\n|---|\n| 1 |"
    done = spark.createDataFrame([("t", "c", 3), ("u", "c", -1)], "task_id string, config string, score int")
    todo = spark.createDataFrame([("t", "c"), ("u", "c")], "task_id string, config string")
    assert [r.task_id for r in unjudged(todo, done).collect()] == ["u"]

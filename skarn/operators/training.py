"""Supervised training sets: prompts, grounding, budget, messages, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.functions import paths
from skarn.functions.text import hash_order

TOP_K = 5
#: Characters an example may have, and the slack kept for headers.
MAX_CHARS, SLACK = 14_745, 200
CHUNK_TYPE = "struct<text:string,source_file:string,section:string,distance:double,protected:boolean>"


def user_prompt(question: Column, chunks: Column) -> Column:
    """Numbered sources, then the question; the bare question without sources."""

    def source(c: Column, i: Column) -> Column:
        return F.concat(
            F.lit("[Source "), (i + 1).cast("string"), F.lit(": "), F.coalesce(c["source_file"], F.lit("")), F.lit(" — "), F.coalesce(c["section"], F.lit("")),
            F.lit("]\n"), F.coalesce(c["text"], F.lit("")),
        )

    told = F.array_join(F.transform(chunks, source), "\n\n---\n\n")
    return F.when(F.size(chunks) > 0, F.concat(F.lit("Context:\n"), told, F.lit("\n\nQuestion: "), question)).otherwise(question)


def system_prompt(use_rag: Column, style: Column, plain: str, grounded: str, strict: str) -> Column:
    return F.when(~use_rag, F.lit(plain)).when(style == "strict", F.lit(strict)).otherwise(F.lit(grounded))


def judge_prompt(template: str, columns: list[str]) -> Column:
    """The template with each ``{column}`` replaced by that column; other braces stay."""
    out: Column = F.lit(template)
    for c in columns:
        out = F.replace(out, F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return out


def parse_judgement(reply: Column) -> Column:
    """A judge's reply, perhaps fenced, as struct<score, reason>; -1 where it is no JSON with a score."""
    bare = F.regexp_replace(reply, r"^\s+|\s+$", "")
    inner = F.when(bare.startswith("```"), F.regexp_replace(F.regexp_replace(bare, r"\A[^\n]*\n", ""), r"(?s)```[^`]*\z", "")).otherwise(bare)
    parsed = F.from_json(inner, "score int, reason string")
    return F.struct(F.coalesce(parsed["score"], F.lit(-1)).alias("score"), F.coalesce(parsed["reason"], F.lit("")).alias("reason"))


def question_from(templates: list[str], action: Column, key: Column, seed: int = 42) -> Column:
    """One of the templates, by digest of the key, with {action} filled in."""
    number = F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("long") % len(templates)
    chosen = F.element_at(F.array(*[F.lit(t) for t in templates]), (number + 1).cast("int"))
    return F.replace(chosen, F.lit("{action}"), action)


def call_answer(method: Column, path: Column, operation: Column, description: Column, required: Column) -> Column:
    """The call in back-ticks, its description with a closing point, at most six required parameters."""
    call = F.concat(
        F.lit("`"), method, F.lit(" "), path, F.lit("`"), F.when(F.coalesce(operation, F.lit("")) != "", F.concat(F.lit(" (operationId `"), operation, F.lit("`)"))).otherwise(F.lit("")), F.lit(".")
    )
    text = F.regexp_replace(F.regexp_replace(F.coalesce(description, F.lit("")), r"(?is)\s+OperationId:.*$", ""), r"^\s+|\s+$", "")
    told = F.when(text == "", F.lit(None)).when(text.endswith("."), text).otherwise(F.concat(text, F.lit(".")))
    needs = F.when(F.size(required) > 0, F.concat(F.lit("Required parameters: "), F.array_join(F.slice(required, 1, 6), ", "), F.lit(".")))
    return F.concat_ws(" ", call, told, needs)


def messages(system: Column, user: Column, answer: Column) -> Column:
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(turn("system", system), turn("user", user), turn("assistant", answer))


def prompt_completion(df: DataFrame, column: str = "messages") -> DataFrame:
    """The first two messages are the prompt, the rest the completion."""
    return df.withColumns({"prompt": F.slice(column, 1, 2), "completion": F.slice(column, F.lit(3), F.greatest(F.size(column) - 2, F.lit(0)))})


def difficulty(steps: Column) -> Column:
    distinct = F.size(F.array_distinct(steps))
    return F.when(distinct <= 3, "basic").when(distinct <= 6, "intermediate").otherwise("advanced")


def inject(chunks: Column, gold: Column, key: Column, k: int = TOP_K, seed: int = 42) -> Column:
    """The gold chunk at a slot drawn by digest, among the first k - 1 retrieved ones; nothing where its text is there or null."""
    kept = F.slice(chunks, 1, k - 1)
    slot = F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("long") % (F.size(kept) + 1)
    there = F.exists(chunks, lambda c: c["text"] == gold["text"])
    return F.when(gold["text"].isNull() | there, chunks).otherwise(F.array_insert(kept, (slot + 1).cast("int"), gold))


def build_set(pairs: DataFrame, lookup: DataFrame, system: str, key: str = "query_id", budget: int = MAX_CHARS, share: float = 0.05) -> DataFrame:
    """The training set from (key, category, module, question, gold_answer, source_text, chunks): source chunk put in,
    gold paths grounded, pairs that cannot be grounded dropped, trimmed to the budget, told as messages, split.

    (key, messages, category, module, n_chars, subset): the smallest digests of the key are 'val'.
    """
    from skarn.operators.curation import train_val_split

    none = F.lit(None).cast("string")
    source = F.struct(F.col("source_text").alias("text"), none.alias("source_file"), none.alias("section"), F.lit(0.0).alias("distance"), F.lit(True).alias("protected"))
    given = pairs.withColumn("chunks", inject(F.col("chunks"), source, F.col(key).cast("string")))
    kept = trim(ground(given, lookup, key).where("grounded"), len(system), budget)
    user = user_prompt(F.col("question"), F.col("chunks"))
    told = kept.select(key, messages(F.lit(system), user, F.col("gold_answer")).alias("messages"), "category", "module", (F.length(user) + F.length("gold_answer")).alias("n_chars"))
    return train_val_split(told, key, share)


def ground(examples: DataFrame, lookup: DataFrame, key: str = "query_id", k: int = TOP_K, seed: int = 42) -> DataFrame:
    """Every path named in the gold answer stands in the context, or its chunk is injected.

    ``examples``: (key, gold_answer, chunks array<CHUNK_TYPE>); ``lookup``: (path, text), one row a path. Injected chunks
    are protected and push out the last retrieved ones; the context is reordered by digest where something was injected.
    Adds ``grounded``: whether all gold paths are visible now.
    """
    wanted = examples.select(key, F.explode(paths.grounding(F.col("gold_answer"))).alias("path"), F.array_join(F.transform("chunks", lambda c: c["text"]), "\n").alias("context"))
    missing = wanted.where(~F.contains("context", F.col("path"))).join(lookup.select("path", "text"), "path", "left")
    injected = missing.groupBy(key).agg(
        F.array_sort(F.collect_set(F.when(F.col("text").isNotNull(), F.struct("path", "text")))).alias("inject"), F.count_if(F.col("text").isNull()).alias("unknown")
    )
    joined = examples.join(injected, key, "left")
    extra = F.transform(
        F.coalesce("inject", F.array().cast("array<struct<path:string,text:string>>")),
        lambda g: F.struct(
            g["text"].alias("text"), F.lit(None).cast("string").alias("source_file"), g["path"].alias("section"), F.lit(0.0).alias("distance"), F.lit(True).alias("protected")
        ),
    )
    merged = F.concat(F.slice("chunks", F.lit(1), F.greatest(F.lit(0), k - F.size(extra))), extra)
    digest = F.transform(merged, lambda c, i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), c["text"], i.cast("string"))).alias("h"), c.alias("c")))
    shuffled = F.transform(F.array_sort(digest), lambda s: s["c"])
    chunks = F.when(F.size(extra) > 0, shuffled).otherwise(F.col("chunks"))
    out = joined.withColumn("chunks", chunks)
    context = F.array_join(F.transform("chunks", lambda c: c["text"]), "\n")
    return out.withColumn("grounded", F.forall(paths.grounding(F.col("gold_answer")), lambda p: F.contains(context, p))).drop("inject", "unknown")


def trim(examples: DataFrame, system_chars: int = 0, budget: int = MAX_CHARS) -> DataFrame:
    """Chunks that fit the budget: protected ones first, then by distance, skipping what does not fit; original order.

    If the protected ones alone exceed it, every kept text is cut to its equal share. Adds ``grounded_after_trim``.
    """
    room = F.lit(budget - system_chars - SLACK) - F.length("gold_answer") - F.length("question")
    numbered = F.transform("chunks", lambda c, i: F.struct(F.when(c["protected"], -1.0).otherwise(c["distance"]).alias("d"), i.alias("i"), F.length(c["text"]).alias("n"), c["protected"].alias("p")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))

    def take(acc: Column, c: Column) -> Column:
        fits = F.coalesce(c["p"], F.lit(False)) | (acc["used"] + c["n"] <= F.col("_room"))
        return F.when(fits, F.struct((acc["used"] + c["n"]).cast("long").alias("used"), F.concat(acc["kept"], F.array(c["i"])).alias("kept"))).otherwise(acc)

    folded = examples.withColumn("_room", room).withColumn("_fold", F.aggregate(F.array_sort(numbered), start, take))
    kept = F.filter("chunks", lambda c, i: F.array_contains(F.col("_fold.kept"), i))
    share = F.floor(F.col("_room") / F.greatest(F.lit(1), F.size("_fold.kept"))).cast("int")

    def cut(c: Column) -> Column:
        short = F.when((F.col("_fold.used") > F.col("_room")) & (F.length(c["text"]) > share), F.substring(c["text"], F.lit(1), F.greatest(share, F.lit(0)))).otherwise(c["text"])
        return F.struct(short.alias("text"), c["source_file"].alias("source_file"), c["section"].alias("section"), c["distance"].alias("distance"), c["protected"].alias("protected"))

    chosen = F.when(F.size("_fold.kept") > 0, F.transform(kept, cut)).otherwise(F.slice("chunks", 1, 1))
    out = folded.withColumn("chunks", chosen).drop("_room", "_fold")
    context = F.array_join(F.transform("chunks", lambda c: c["text"]), "\n")
    return out.withColumn("grounded_after_trim", F.forall(paths.grounding(F.col("gold_answer")), lambda p: F.contains(context, p)))


def set_stats(examples: DataFrame, size: Column, fields: dict[str, Column]) -> DataFrame:
    """(field, value, examples, min_chars, median_chars, max_chars): for all and by each of ``fields``; the upper median, exact,
    from a histogram of sizes."""
    each = F.explode(F.array(F.struct(F.lit("all").alias("field"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in fields.items()]))
    rows = examples.select(size.alias("n"), each.alias("f")).select("n", "f.field", "f.value").where("n IS NOT NULL")
    histogram = rows.groupBy("field", "value", "n").agg(F.count("*").alias("c"))
    group = Window.partitionBy("field", "value")
    upto = histogram.withColumns({"upto": F.sum("c").over(group.orderBy("n")), "total": F.sum("c").over(group)})  # one row a size
    return upto.groupBy("field", "value").agg(
        F.sum("c").alias("examples"), F.min("n").alias("min_chars"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("n"))).alias("median_chars"), F.max("n").alias("max_chars")
    )


def workflow_tasks(workflows: DataFrame, order: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """Tasks from (name, module, steps array<struct<name,method,path>>): question, numbered expected answer, operations,
    difficulty by distinct calls and a running id in the order of ``order``. Names that start with one of ``skip`` are left out."""
    from skarn.operators.corpus import global_position

    kept = workflows
    for start in skip:
        kept = kept.where(~F.startswith("name", F.lit(start)))
    call = lambda s: F.concat(s["method"], F.lit(" "), s["path"])
    calls = F.transform("steps", call)
    told = F.array_join(F.transform("steps", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s["name"], F.lit(": "), call(s))), "\n")
    distinct = F.size(F.array_distinct(calls)).cast("string")
    tasks = kept.select(
        order, "module", F.lit("api_orchestration").alias("category"), difficulty(calls).alias("difficulty"),
        F.concat(F.lit("What is the complete API workflow for: "), "name", F.lit("? List all required API calls in order.")).alias("question"),
        F.concat(F.lit("The required API sequence is:\n"), told).alias("expected_answer"),
        F.transform("steps", lambda s: s["name"]).alias("required_operations"),
        F.concat(F.lit("Must identify the correct sequence of "), distinct, F.lit(" unique API calls in the right order. Partial credit for getting key steps.")).alias("evaluation_criteria"),
    )
    placed = global_position(tasks, [order])
    number = (F.col("position") + 1).cast("string")
    return placed.withColumn("id", F.concat(F.lit("wf-orch-"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))).drop("position")


def source_lines(chunks: Column) -> Column:
    """The numbered sources of an answer as a reader sees them: file, section and distance to three places."""
    return F.transform(
        chunks,
        lambda c, i: F.concat(
            (i + 1).cast("string"), F.lit(". **"), F.coalesce(c["source_file"], F.lit("?")), F.lit("** — "), F.coalesce(c["section"], F.lit("?")), F.lit(" (distance: "),
            F.format_string("%.3f", c["distance"]), F.lit(")"),
        ),
    )


def source_texts(chunks: Column, size: int = 1000) -> Column:
    return F.transform(chunks, lambda c: F.substring(c["text"], 1, size))


def resolve_config(configs: DataFrame, name: str, key: str = "config", **overrides) -> dict:
    """One configuration as a dict with overrides; an unknown name or setting is an error."""
    row = configs.where(F.col(key) == name).first()
    if row is None:
        raise KeyError(f"unknown configuration {name!r}")
    if unknown := set(overrides) - set(configs.columns):
        raise KeyError(f"unknown settings: {', '.join(sorted(unknown))}")
    return row.asDict() | overrides


def with_overrides(configs: DataFrame, overrides: DataFrame, key: str = "config") -> DataFrame:
    """Configurations with the settings of ``overrides`` (key, some settings) that are not null in place of their own."""
    named = [c for c in overrides.columns if c != key]
    joined = configs.join(F.broadcast(overrides.select(key, *[F.col(c).alias(f"_{c}") for c in named])), key, "left")  # a stated list
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in named else F.col(c) for c in configs.columns])

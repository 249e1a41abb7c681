"""Problem 3: splits that keep related records together.

Method: frontier breadth-first components. Records that share a key (asker, ticket, task) are related. The graph that is
searched has the keys as vertices and an edge for each pair of keys met in one record, each record chaining its keys,
duplicates merged before the shuffle; a key that a third of all records share is one vertex, and its records with no
other key never enter the search. Adjacency lists are hash-partitioned by vertex. Every vertex whose digest is the
smallest among its neighbours is a seed; all seeds expand at once, a frontier a round. Where two seeds meet, their
labels become an edge of a smaller graph, which is treated in the same way until it has no edge.
Components go to train, validation and test in the order of their digest, by running share of rows.

Defined results. A record without keys, or with keys nobody else has, is a group of its own and not listed. Null
messages or contents: no keys. The code of a house that looks like a ticket (PMS12) is no key. Repeated record ids are one record. Keys compare without case, separators, leading zeros
and revision marks. An empty table gives no groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.plans.shared import materialize
from skarn.plans.skew import salted_join

PROPORTIONS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))

#: How a person, a ticket and a task are written in the messages of small tables, as the SQL reads them.
HANDLE = r"@?[A-Za-z]{4,}[ ._\-]?[0-9]{3,6}"
ASKED = rf"(?i)\b(?:this is|raised by|asked by|requester:|requested by|from:|hi|hello|dear)[ ]+({HANDLE})\b"
WROTE = rf"(?i)({HANDLE})[ ]+wrote:"
TICKET = r"(?i)\bPMS[ #_\-./]*([0-9]+)\b"
TASK = r"(?i)\b(rsv|fof|hsk|crm|mul)[ _\-./]+(orch|conf|trbl)[ _\-./]+([0-9]+)"
CONTEXT_END = "\n\nQuestion:"
#: How this operator reads them. The numbers of people grow with the tables, so their digits have no upper limit; PMS with
#: two digits right behind it is the code of a house, as any three letters with two digits are, and no ticket.
ANY_HANDLE = HANDLE.replace("{3,6}", "{3,}")
ASKER, WRITER = ASKED.replace(HANDLE, ANY_HANDLE), WROTE.replace(HANDLE, ANY_HANDLE)
TICKET_NUMBER = TICKET.replace("PMS", r"PMS(?![0-9]{2}\b)")


def _squash(column: Column) -> Column:
    """Lower case, letters and digits only, no leading zeros in the number."""
    return F.regexp_replace(F.regexp_replace(F.lower(column), "[^a-z0-9]", ""), "(?<![0-9])0+(?=[0-9])", "")


def message_keys(messages: str = "messages") -> Column:
    """Array of keys in a chat: its askers, tickets and tasks. Files quoted before the question are left out."""
    said = F.filter(F.col(messages), lambda m: (F.coalesce(m["role"], F.lit("")) != "system") & m["content"].isNotNull())

    text = F.array_join(
        F.transform(
            said,
            lambda m: F.when(
                m["content"].startswith("Context:") & m["content"].contains(CONTEXT_END),
                F.regexp_replace(m["content"], r"(?s)\AContext:.*?\n\nQuestion:", " "),
            ).otherwise(m["content"]),
        ),
        "\n",
    )
    people = F.concat(F.regexp_extract_all(text, F.lit(ASKER), 1), F.regexp_extract_all(text, F.lit(WRITER), 1))
    return F.array_distinct(
        F.concat(
            F.transform(people, lambda p: F.concat(F.lit("p:"), _squash(p))),
            F.transform(F.regexp_extract_all(text, F.lit(TICKET_NUMBER), 1), lambda t: F.concat(F.lit("t:"), _squash(t))),
            F.transform(F.regexp_extract_all(text, F.lit(TASK), 0), _task_key),
        )
    )


def _task_key(column: Column) -> Column:
    parts = F.regexp_replace(F.lower(column), "[^a-z0-9]+", " ")
    return F.concat(
        F.lit("b:"), F.regexp_extract(parts, r"^(\w+) (\w+) 0*(\d+)", 1), F.lit("-"), F.regexp_extract(parts, r"^(\w+) (\w+) 0*(\d+)", 2),
        F.lit("-"), F.regexp_extract(parts, r"^(\w+) (\w+) 0*(\d+)", 3),
    )


def task_keys(task_id: str = "id") -> Column:
    """The key of a task's own id; an id of another form is its own key."""
    known = F.regexp_extract(F.col(task_id), TASK, 0)
    return F.when(F.col(task_id).isNull(), F.array().cast("array<string>")).otherwise(
        F.array(F.when(known != "", _task_key(known)).otherwise(F.concat(F.lit("b:"), _squash(F.col(task_id)))))
    )


def components(edges: DataFrame) -> DataFrame:
    """(a, b) strings or numbers -> (vertex, component): connected components by concurrent frontier search.

    The component of a vertex is a vertex of it. Each level labels every vertex with a seed; labels that touch are the
    edges of the next level, which has at most half as many vertices, as no two seeds are neighbours.
    """
    both = edges.select("a", "b").where(F.col("a") != F.col("b"))
    adjacency = materialize(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "p3-adjacency")
    assigned = None
    while True:
        rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
        nearest = adjacency.groupBy("a").agg(F.min(rank("b")).alias("low"))
        if nearest.isEmpty():
            break
        seeds = nearest.where(rank("a") < F.col("low")).select(F.col("a").alias("vertex"), F.col("a").alias("label"))
        labels = materialize(seeds, "p3-seeds")
        frontier = labels
        while True:
            reached = (
                frontier.join(adjacency, frontier["vertex"] == adjacency["a"])
                .groupBy(F.col("b").alias("vertex"))
                .agg(F.min("label").alias("label"))
                .join(labels.select("vertex"), "vertex", "left_anti")
            )
            frontier = materialize(reached, "p3-frontier")
            if frontier.isEmpty():
                break
            labels = labels.unionByName(frontier)
        labels = materialize(labels, "p3-labels")
        ends = labels.select(F.col("vertex").alias("b"), F.col("label").alias("label_b"))
        touching = (
            adjacency.join(labels.withColumnRenamed("vertex", "a"), "a")
            .join(ends, "b")
            .where(F.col("label") != F.col("label_b"))
            .select(F.col("label").alias("a"), F.col("label_b").alias("b"))
            .distinct()
        )
        if assigned is None:
            assigned = labels.withColumnRenamed("label", "component")
        else:
            up = labels.select(F.col("vertex").alias("component"), F.col("label").alias("upper"))
            assigned = assigned.join(up, "component", "left").select(
                "vertex", F.coalesce("upper", "component").alias("component")
            )
        adjacency = materialize(touching, "p3-merged")
    if assigned is None:
        return adjacency.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return materialize(assigned, "p3-components")


def record_groups(records: DataFrame) -> DataFrame:
    """(record_id, keys array) -> (record_id, group_id, members): group_id is the smallest record_id of the group."""
    # rows of a repeated id share one more key, the id itself
    repeated = records.groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1").select("record_id", F.lit(True).alias("again"))
    marked = salted_join(records.select("record_id", "keys"), repeated, "record_id", "left")
    own = F.when(F.col("again"), F.array(F.concat(F.lit("r:"), "record_id"))).otherwise(F.array().cast("array<string>"))
    keyed = materialize(marked.select("record_id", F.array_sort(F.array_distinct(F.concat("keys", own))).alias("keys")), "p3-records")
    chained = F.transform(
        F.sequence(F.lit(1), F.size("keys") - 1), lambda i: F.struct(F.col("keys")[i - 1].alias("a"), F.col("keys")[i].alias("b"))
    )
    edges = keyed.where(F.size("keys") > 1).select(F.explode(chained).alias("e")).select("e.a", "e.b").distinct()
    component = components(edges)
    first = keyed.withColumn("key", F.get("keys", F.lit(0))).select("record_id", "key")
    alone = first.where("key IS NULL").select("record_id", F.lit(None).cast("string").alias("component"))
    joined = salted_join(first.where("key IS NOT NULL"), component.withColumnRenamed("vertex", "key"), "key", "left", "record_id")
    placed = joined.select("record_id", F.coalesce("component", "key").alias("component"))
    placed = placed.unionByName(alone).distinct()
    placed = materialize(placed, "p3-placed")
    groups = placed.where("component IS NOT NULL").groupBy("component").agg(
        F.min("record_id").alias("group_id"), F.count("*").alias("members")
    )
    grouped = salted_join(placed.where("component IS NOT NULL"), groups, "component", "inner", "record_id")
    single = placed.where("component IS NULL").select("record_id", F.col("record_id").alias("group_id"), F.lit(1).cast("long").alias("members"))
    return grouped.select("record_id", "group_id", "members").unionByName(single)


def assign_splits(groups: DataFrame, proportions=PROPORTIONS, buckets: int = 1024) -> DataFrame:
    """(record_id, group_id, members) -> + split. Groups stand in the order of their digest; a group goes where its
    middle row falls on the running share of rows.

    The running sum is made in two steps: over the totals of ``buckets`` ranges of the digest, then inside each range.
    """
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("rows")).withColumn("digest", F.xxhash64("group_id"))
    sizes = materialize(sizes.withColumn("bucket", F.floor((F.col("digest") / F.lit(2.0**64) + 0.5) * buckets).cast("int")), "p3-sizes")
    totals = sizes.groupBy("bucket").agg(F.sum("rows").alias("bucket_rows"))
    before = totals.select(
        "bucket",
        (F.sum("bucket_rows").over(Window.orderBy("bucket")) - F.col("bucket_rows")).alias("before"),
        F.sum("bucket_rows").over(Window.partitionBy()).alias("all_rows"),
    )
    inside = Window.partitionBy("bucket").orderBy("digest", "group_id")
    middle = (F.col("before") + F.sum("rows").over(inside) - F.col("rows") / 2) / F.col("all_rows")
    placed = sizes.join(F.broadcast(before), "bucket").withColumn("middle", middle)  # at most `buckets` rows
    split, edge = F.lit(proportions[-1][0]), 1.0
    for name, share in reversed(proportions[:-1]):
        edge -= proportions[[n for n, _ in proportions].index(name) + 1][1]
        split = F.when(F.col("middle") < edge, F.lit(name)).otherwise(split)
    return salted_join(groups, placed.select("group_id", split.alias("split")), "group_id", "inner", "record_id").select(
        "record_id", "group_id", "members", "split"
    )

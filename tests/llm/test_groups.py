"""Problem 3: against union-find, and awkward input."""

from __future__ import annotations

import random

from skarn.llm import groups


def union_find(records):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for record, keys in records:
        find(("r", record))
        for k in keys:
            parent[find(("r", record))] = find(("k", k))
    members = {}
    for record, _ in records:
        members.setdefault(find(("r", record)), set()).add(record)
    return {r: (min(m), len(m)) for m in members.values() for r in m}


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    records = [(f"r{n:03}", [f"k{rng.randrange(250)}" for _ in range(rng.choice([0, 1, 1, 2, 3]))]) for n in range(300)]
    records += [(f"h{n:03}", ["hot"]) for n in range(150)] + [("r001", ["hot"]), ("r001", []), ("r002", ["k1"])]
    records += [(f"c{n:03}", [f"chain{n}", f"chain{n + 1}"]) for n in range(60)]
    got = groups.record_groups(spark.createDataFrame(records, "record_id string, keys array<string>")).collect()
    assert {r.record_id: (r.group_id, r.members) for r in got} == union_find(records)
    assert len(got) == len({r.record_id for r in got})


def test_keys_from_messages(spark):
    context = "Context:\n[Source 1: rsv-orch-00000001.md — PMS-1]\nFrom: filea_1000\n\nQuestion: "
    chats = [
        [("system", "from: sysadm_1111"), ("user", context + "This is @Melurdow-1073, desk side. (from thread Pms_010092) cc @other_2000"), ("assistant", "Dear melurdow.1073, done.")],
        [("user", "CAELATHSEN 1571 wrote: based on rsv/orch/00188-v2 and task=RSV_ORCH_188")],
        [("user", None)],
        None,
    ]
    df = spark.createDataFrame([(c,) for c in chats], "messages array<struct<role:string,content:string>>")
    got = [sorted(r[0]) if r[0] is not None else None for r in df.select(groups.message_keys()).collect()]
    assert got == [["p:melurdow1073", "t:10092"], ["b:rsv-orch-188", "p:caelathsen1571"], [], None]


def test_keys_of_large_tables(spark):
    """People's numbers of seven digits and more, and codes of houses that look like tickets."""
    said = ["This is @Melurdow-1073123, desk side.", "TORILIK 12345678 wrote:", "House PMS80 of Tidemark. Asked by varebey.8136.", "Inn Pemefeld (PMS12), see PMS#12 and pms0012 and PMS123"]
    df = spark.createDataFrame([([("user", t)],) for t in said], "messages array<struct<role:string,content:string>>")
    got = [sorted(r[0]) for r in df.select(groups.message_keys()).collect()]
    assert got == [["p:melurdow1073123"], ["p:torilik12345678"], ["p:varebey8136"], ["t:12", "t:123"]]


def test_task_keys(spark):
    df = spark.createDataFrame([("rsv-orch-00000188",), ("RSV_ORCH_00000188",), ("rsv-orch-00000188.r2",), ("rsv-orch-00000188_alt2",), ("other",), (None,)], "id string")
    got = [list(r[0]) for r in df.select(groups.task_keys()).collect()]
    assert got[:4] == [["b:rsv-orch-188"]] * 4 and got[4:] == [["b:other"], []]


def test_splits_keep_groups_and_shares(spark):
    rows = [(f"r{n}", f"g{n // 3}", 3) for n in range(3000)]
    got = groups.assign_splits(spark.createDataFrame(rows, "record_id string, group_id string, members long"), buckets=16).collect()
    assert len(got) == 3000
    by_group, share = {}, {}
    for r in got:
        by_group.setdefault(r.group_id, set()).add(r.split)
        share[r.split] = share.get(r.split, 0) + 1
    assert all(len(s) == 1 for s in by_group.values())
    assert abs(share["train"] - 2400) <= 6 and abs(share["validation"] - 300) <= 6 and abs(share["test"] - 300) <= 6


def test_empty(spark):
    empty = spark.createDataFrame([], "record_id string, keys array<string>")
    assert groups.record_groups(empty).count() == 0

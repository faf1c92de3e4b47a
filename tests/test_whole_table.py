"""Queries read every row of events, whatever dates the view gives them."""

from __future__ import annotations

from collections import defaultdict

import duckdb
import pytest

from threadloom.plans.views import GATE, oracle
from threadloom.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in ("events", "conversations"):
        con.execute(f"create view {name} as select * from '{small}/{name}.parquet'")
    return con


def test_census_reads_all_files(spark, small, duck):
    r = QUERIES["match_census"](spark, small).first()
    assert r["dated_files"] + r["undated_files"] == duck.execute("select count(*) from events").fetchone()[0]


def test_pairs_read_all_files(spark, small, duck):
    """Copies by direction and both patterns of each pair, from plain loops over the views."""
    want, days, seen = defaultdict(lambda: [0, 0]), defaultdict(list), defaultdict(lambda: [set(), set()])
    for source, group, day, token, sent in duck.execute(oracle(" SELECT source_id, group_id, CAST(file_date AS VARCHAR), token, is_sent FROM tokens JOIN device_groups USING (source_id) WHERE token IS NOT NULL", GATE)).fetchall():
        for key in (("SourceDate", source, day), ("DeviceGroupDate", group, day)):
            want[key]
            if sent is not None:
                want[key][not sent] += 1
                seen[key][not sent].add(token)
    for day, pattern in duck.execute(ORACLE_SQL["message_patterns"]).fetchall():
        days[str(day)] = pattern
    rows = QUERIES["gate_pairs"](spark, small).collect()
    got = {(r["scope"], r["scope_key"], str(r["file_date"])): r for r in rows}
    assert want.keys() <= got.keys() and len(got) == len(rows)
    for key, r in got.items():
        o, i = seen[key] if key in seen else (set(), set())
        pattern = "".join("O" if t in o else "I" for t in sorted(o ^ i))
        assert (r["sent_copies"], r["not_sent_copies"]) == tuple(want[key] if key in want else (0, 0)), key
        assert r["token_pattern"] == pattern and r["conflicts"] == len(o & i) and r["pattern"] == (days[key[2]] or ""), key
    states = {(r["scope"], r["state"]): r["pairs"] for r in QUERIES["pair_states"](spark, small).collect()}
    assert sum(states.values()) == len(rows)


def test_strict_order_reads_all_files(spark, small, duck):
    groups = duck.execute(ORACLE_SQL["cohort_groups"])
    names = [c[0] for c in groups.description]
    single = defaultdict(dict)
    for g in (dict(zip(names, r, strict=True)) for r in groups.fetchall()):
        if g["relations"] == 1:
            single[str(g["message_date"])[:10]][g["direction"]] = g
    want = {}
    for day, g in single.items():
        if len(g) == 2:
            o, i = ([int(x) for x in g[d]["tokens"].split(",") if x] for d in ("Outgoing", "Incoming"))
            if not o or not i:
                want[day] = "NoToken"
            elif len(o) > 1 or len(i) > 1:
                want[day] = "SeveralTokens"
            elif o == i:
                want[day] = "EqualTokens"
            else:
                want[day] = "Concordant" if (o < i) == (g["Outgoing"]["first_sequence"] < g["Incoming"]["first_sequence"]) else "Discordant"
    assert {str(r["message_date"]): r["verdict"] for r in QUERIES["strict_order"](spark, small).collect()} == want


def test_relations_shuffle_no_pairs(spark, small):
    """What grows as the product of files and messages is written and no more: nothing is grouped or dealt after they meet."""
    for name in ("exact_relations", "adjacent_relations"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan()
        assert "block" in plan.toString() and _above_meeting(plan) == [], name


def _above_meeting(plan) -> list[str]:
    """Aggregates and repartitions above the first join by block; branches of numbers that repeat have none."""
    name, children = plan.nodeName(), [plan.children().apply(i) for i in range(plan.children().size())]
    if name == "Join" and "block" in plan.condition().toString():
        return []
    below = [x for c in children if "block" in c.toString() for x in _above_meeting(c)]
    return ([name] if name in ("Aggregate", "RepartitionByExpression", "Sort", "Window") else []) + below


def test_relations_take_little_disk(spark, tmp_path):
    """Rows come in an order that is short when written; which rows there are is compared elsewhere."""
    from threadloom.operators.matching import exact_relations

    a = spark.range(1501).selectExpr("id as attachment_id", "id + 1 as sequence_number", "date '2024-01-01' as message_date", "id % 3 as sender_id")
    f = spark.range(2000).selectExpr("id as file_id", "id % 4 + 1 as source_id", "id * 7 as asset_id", "date '2024-01-01' as file_date", "id % 5 < 2 as is_sent", "1L as size", "if(id % 7 < 3, 'Image', 'Video') as media_type")
    exact_relations(a, f, 1).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").distinct().count() == 1501 * 2000
    assert sum(p.stat().st_size for p in tmp_path.glob("out/*.parquet")) < 0.4 * 1501 * 2000


def test_adjacent_relations_of_a_number_that_repeats(spark):
    """Rows with one number are one attachment, over all their dates."""
    from threadloom.operators.matching import adjacent_relations

    rows = [(1, 1, "2024-01-02", 1), (1, 2, "2024-01-04", 1), (2, 3, "2024-01-04", 2)]
    a = spark.createDataFrame(rows, "attachment_id long, sequence_number long, d string, sender_id long").selectExpr("attachment_id", "sequence_number", "to_date(d) as message_date", "sender_id")
    files = [(1, 1, 7, "2024-01-03", True), (2, 2, 7, "2024-01-03", False), (3, 1, 8, "2024-01-01", True), (4, 1, 8, "2024-01-02", True), (5, 1, 9, "2024-01-05", None)]
    f = spark.createDataFrame(files, "file_id long, source_id long, asset_id long, d string, is_sent boolean").selectExpr("file_id", "source_id", "asset_id", "to_date(d) as file_date", "is_sent", "1L as size", "'Image' as media_type")
    got = {tuple(r) for r in adjacent_relations(a, f, 1).collect()}
    assert got == {(1, 7, True, True, 4, 2, "Mixed"), (1, 9, False, True, 1, 1, "Unknown"), (2, 7, True, False, 2, 2, "Mixed"), (2, 9, False, True, 1, 1, "Unknown")}


def test_adjacent_relations_of_numbers_that_repeat_group_no_pairs(spark, small):
    union = QUERIES["adjacent_relations"](spark, small)._jdf.queryExecution().optimizedPlan()
    while union.nodeName() != "Union":
        union = union.children().apply(0)
    for i in range(union.children().size()):
        branch = union.children().apply(i)
        assert "block" in branch.toString() and _above_meeting(branch) == []


def test_adjacent_relations_of_a_long_conversation(spark, small, tmp_path):
    """Its turns from 100 on have numbers of the next conversation's; a sender known on either row is the attachment's."""
    con = duckdb.connect()
    con.execute(f"copy (select * from '{small}/events.parquet') to '{tmp_path}/events.parquet'")
    con.execute(f"""copy (with c as (select conv_id, turn, role from '{small}/conversations.parquet')
     select * from c union all select conv_id - 1, turn + 100, if(conv_id % 2 = 0, role, 'system') from c where conv_id % 3 > 0) to '{tmp_path}/conversations.parquet'""")
    for name in ("events", "conversations"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    df = QUERIES["adjacent_relations"](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(df.columns)} from ({ORACLE_SQL['adjacent_relations']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) > 0


def test_exact_counts_are_made_once_for_each_shape(spark, small):
    """Pairs that share a shape share the counts: the plan joins them, and each pair is still there."""
    counts = QUERIES["reference_counts"](spark, small)
    assert "ArrowEvalPython" not in counts._jdf.queryExecution().executedPlan().toString()
    states = {(r["scope"], r["state"]): r["pairs"] for r in QUERIES["pair_states"](spark, small).collect()}
    assert counts.count() == sum(n for (_, state), n in states.items() if state == "Classified")


def test_guards_search_names_once(spark, small):
    """One pass for the rules on dates, and the tables that many guards read are made before."""
    plan = QUERIES["guard_counts"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(name") <= 1

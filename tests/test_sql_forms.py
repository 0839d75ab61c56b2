"""Recipes in recursive SQL, traces as variants, chunks as a table function."""

from pantrygrid.functions import text as t
from pantrygrid.operators import dishes, logs
from pyspark.sql import functions as F


def test_recipes_open_but_for_closed_parts_and_cycles_end(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (2, 4), (3, 1), (4, 5), (5, 6), (7, 7), (8, 4), (None, 1), (9, None)], "parent int, child int")
    got = {(r["root"], r["node"]): r["leaf"] for r in dishes.expanded(edges, [4]).collect()}
    assert {n for r, n in got if r == 1} == {1, 2, 3, 4} and {n for r, n in got if r == 4} == {5, 6}
    assert got[(1, 4)] and not got[(1, 2)] and got[(4, 6)] and not got[(4, 5)]  # 4 stays closed; 2 and 5 have parts
    assert {n for r, n in got if r == 7} == {7} and {n for r, n in got if r == 8} == {4} and not {r for r, _ in got} & {None, 9}
    whole = {(r["root"], r["node"]) for r in dishes.expanded(edges).collect()}
    assert whole == {(r["root"], r["node"]) for r in dishes.leaves(spark, edges.dropna()).collect()}
    assert dishes.expanded(edges.limit(0)).collect() == []
    for stop in ([], [4]):  # in layers the same as in rounds
        assert sorted(map(tuple, dishes.expanded(edges, stop, many=0).collect())) == sorted(map(tuple, dishes.expanded(edges, stop).collect()))


def test_recipes_do_not_walk_each_path_nor_pass_the_driver(spark):
    deep = spark.range(6).selectExpr("explode(array(3 * id, 3 * id + 1, 3 * id + 2)) AS parent").selectExpr("parent", "explode(array(3 * (parent div 3) + 3, 3 * (parent div 3) + 4, 3 * (parent div 3) + 5)) AS child")  # 3 ** 6 paths
    for many in (0, dishes.MANY):
        got = dishes.expanded(deep, many=many)
        assert got.count() == 3 * sum(3 * k for k in range(1, 7)) and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert not got.where("leaf <> (node >= 18)").count()


def test_traces_are_read_as_far_as_they_are_json(spark):
    rows = [
        (1, '[{"node": "a", "seconds": 0.5}, {"node": "b", "seconds": 2, "llm": ["x", {"y": 1}]}, {"node": "a", "seconds": 1.5}]'),
        (2, '[{"node": "a", "seconds": "soon"}, 7]'), (3, "[{"), (4, None), (5, "{}"), (6, "[]"), (7, '[{"node": "b", "seconds": 4}]'), (8, '"text"'),
    ]
    turns = spark.createDataFrame(rows, "turn long, trace string")
    steps = logs.trace_steps(turns)
    got = sorted((r["turn"], r["pos"], r["node"] or "", r["seconds"], r["calls"]) for r in steps.collect())
    assert got[:3] == [(1, 0, "a", 0.5, 0), (1, 1, "b", 2.0, 2), (1, 2, "a", 1.5, 0)] and {r[0] for r in got} == {1, 2, 7} and (2, 1, "", None, 0) in got
    medians = {r["node"]: (r["turns"], r["seconds"], r["calls"]) for r in logs.step_medians(steps.where("turn <> 2")).collect()}
    assert medians == {"a": (1, 2.0, 0.0), "b": (2, 3.0, 1.0)}


def test_chunks_in_sql_are_those_of_the_splitter(spark):
    long = "## Methods\n\n" + "Some words stand here. " * 90 + "\n\n## Results\n\nshort.\n\n" + "More words stand there. " * 60
    docs = spark.createDataFrame([(1, "T", long), (2, "U", "too short"), (3, "V", None), (4, None, "x" * 200), (5, "W", "")], "doc_id long, title string, text string")
    t.register_chunks(spark)
    got = spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL chunks(d.text, 900, 150, d.title) c", docs=docs).collect()
    mine = sorted((r["pos"], r["text"]) for r in got if r["doc_id"] == 1)
    assert mine == list(enumerate(f"T\n\n{c.strip()}" for c in t.split(long, 900, 150) if len(c.strip()) >= t.LEAST_CHUNK))
    assert [r["section"] for r in sorted(got, key=lambda r: r["pos"]) if r["doc_id"] == 1][0] == "Methods"
    assert {r["section"] for r in got if r["doc_id"] == 1} == {"Methods", "Results"}
    assert {r["doc_id"] for r in got} == {1, 4} and next(r["text"] for r in got if r["doc_id"] == 4) == "x" * 200
    plain = spark.sql("SELECT c.text FROM {docs} d, LATERAL chunks(d.text, 900, 150) c WHERE d.doc_id = 1", docs=docs)
    assert plain.where(F.col("text").startswith("T\n\n")).count() == 0


def test_plans_are_checked_without_distinct_pairs_in_memory(spark):
    rows = [(1, 5, 100.0, 50.0, 100.0), (1, 6, 600.0, 50.0, 100.0), (2, 5, 30.0, 50.0, 100.0), (2, 7, 30.0, 40.0, 100.0), (2, 5, 29.0, 1.0, 100.0), (3, None, 30.0, 94.0, 100.0), (4, 5, 601.0, 93.9, 100.0)]
    got = dishes.plan_checks(spark.createDataFrame(rows, "plan long, dish long, grams double, kcal double, target double"))
    assert {tuple(r) for r in got.collect()} == {(1, 100.0, True, True, True), (2, 91.0, False, False, False), (3, 94.0, True, False, True), (4, 93.9, False, True, False)}
    assert "distinct" not in got._jdf.queryExecution().executedPlan().toString()

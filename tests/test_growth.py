"""Steps whose cost must not grow faster than their input, seen in the plans or in the rounds taken."""

from pyspark.sql import functions as F

from sparkloom import catalog
from sparkloom.functions import evidence as ev
from sparkloom.operators import chunking, entities, graph, lexical
from sparkloom.operators.neighbours import neighbours

TINY = "/root/testdata/sf0.001"


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_neighbours_count_words_of_chunks_taken_only(spark):
    rows = [(f"c{i:03}", "s", 1, None, ["h"], i, "w" if i < 9 else "!") for i in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_id string, version_id long, parent_id string, heading array<string>, seq long, text string")
    seeds = spark.createDataFrame([(1, 0, "c000", 0.9), (1, 1, "c001", 0.8)], "query_id long, seed_no int, chunk_id string, rerank double")
    terms = spark.createDataFrame([(1, {"w": 1}, 1)], "query_id long, counts map<string, int>, n int")
    # counting the words of a chunk that is far from every seed fails
    counted = F.when(F.col("text") == "!", F.raise_error(F.lit("not taken")).cast("map<string, int>")).otherwise(F.create_map(F.col("text"), F.lit(1)))
    got = [r["chunk_id"] for r in neighbours(chunks, seeds, terms, 2, 4, counted).orderBy("rank").collect()]
    assert got == ["c002", "c003"]


def test_citation_seeks_its_quote_once(spark):
    df = spark.createDataFrame([("x" * 400 + " Needle", ["absent", "needle"])], "text string, terms array<string>")
    none = F.lit(None).cast("string")
    one = df.select(ev.citation(F.lit("s"), F.lit("s"), F.lit("c"), F.col("text"), F.lit(None).cast("int"), none, none, F.col("terms"), F.lit(1.0)).alias("c")).select("c.citation_id", "c.quote")
    assert planned(one).count("instr(") == 1
    assert one.first()["quote"].endswith(" Needle")


def test_relations_follow_within_a_chunk_without_a_window(spark):
    rows = [("t", 1, "1:0", "Alpha Beta"), ("t", 1, "1:1", "xray yoke xray"), ("t", 2, "2:0", None), ("t", 3, "3:0", "")]
    _, _, relations = entities.build_graph(spark.createDataFrame(rows, "tenant_id string, doc_id long, chunk_id string, chunk_text string"))
    assert "Window" not in planned(relations)
    assert sorted((r["kind"], r["evidence"]) for r in relations.collect()).count(("CO_OCCURS_WITH", "1:1")) == 1


def test_an_entitys_key_is_made_once_a_name(spark):
    df = spark.createDataFrame([("t", 1, "1:0", "Alpha beta ALPHA")], "tenant_id string, doc_id long, chunk_id string, chunk_text string")
    nodes = entities.build_graph(df)[0]
    plan = planned(nodes)
    assert "array_append" not in plan
    assert plan.index("ArrowEvalPython") < plan.rindex("Aggregate")
    assert {r["name"] for r in nodes.collect()} == {"ALPHA", "beta"}


def test_reach_doubles_each_round(spark, monkeypatch):
    taken, settle = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: taken.append(1) or settle(df))
    chain = spark.createDataFrame([(i, [i - 1] if i else []) for i in range(18)], "call_id long, depends_on array<long>")
    assert graph.reachable(chain).count() == 18 * 17 // 2
    assert len(taken) <= 14


def test_a_cycle_is_found_though_its_calls_wait_for_a_missing_one(spark):
    calls = spark.createDataFrame([(1, [2, -1]), (2, [1]), (3, [-1]), (4, None), (5, [5])], "call_id long, depends_on array<long>")
    assert {tuple(r) for r in graph.faults(calls).collect()} == {(1, "missing"), (3, "missing"), (1, "cycle"), (2, "cycle"), (5, "cycle")}


def test_attempts_are_measured_in_their_rows(spark):
    plan = planned(catalog.queries()["accepted_attempts"](spark, TINY))
    assert "Generate" not in plan and "Expand" not in plan


def test_overlap_is_summed_where_the_texts_lie(spark):
    rows = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, None)], "id long, text string")
    asked = spark.createDataFrame([(7, "a", 3), (7, "b", 1), (8, "c", 1)], "query_id long, term string, qtf long")
    df = lexical.term_overlap(rows, "id", F.col("text"), asked)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in df.collect()} == {(7, 1, 3), (7, 2, 1), (8, 2, 1)}


def test_expansion_groups_once_a_hop_and_writes_what_goes_on(spark, monkeypatch):
    taken, settle = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: taken.append(1) or settle(df))
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "b"), ("c", "d")], "src string, dst string")
    df = graph.expand(spark.createDataFrame([("a",)], "seed string"), edges, 2)
    assert taken and planned(df).count("Aggregate") == 1
    assert {tuple(r) for r in df.collect()} == {("a", "a", 0, None), ("a", "b", 1, "a"), ("a", "c", 2, "b")}


def test_blocks_of_documents_come_in_batches_not_a_group_each(spark):
    rows = [(1, 1, "heading", "Head"), (1, 2, "paragraph", "some words"), (2, 1, "paragraph", None), (3, 2, "paragraph", "b"), (3, 1, "paragraph", "a")]
    df = chunking.parent_child_chunks(spark.createDataFrame(rows, "doc long, pos int, kind string, text string"), "doc", "pos", "text", "kind", 20, 24, 4)
    assert "FlatMapGroups" not in planned(df)
    assert {tuple(r) for r in df.collect()} == {(1, 0, 1, "text", "Head\nsome words"), (3, 0, 0, "text", "a\n\nb")}

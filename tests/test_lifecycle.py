from pyspark.sql import functions as F

from sparkloom.operators import chunking, entities, orchestrate, registry


def test_versions_activate_retire_and_fail(spark):
    log = [("t", "s", "v1", "building", 1), ("t", "s", "v1", "activated", 2), ("t", "s", "v2", "building", 3), ("t", "s", "v2", "failed", 4), ("t", "s", "v3", "activated", 5), ("t", "s", "v1", "activated", 6), ("t", "q", "v9", "building", 7)]
    df = spark.createDataFrame(log, "tenant_id string, source_id string, version_id string, event string, seq long")
    assert {r["version_id"]: r["status"] for r in registry.version_status(df).collect()} == {"v1": "active", "v2": "failed", "v3": "retired", "v9": "building"}
    assert [(r["source_id"], r["version_id"]) for r in registry.active_versions(df).collect()] == [("s", "v1")]


def test_ingesting_twice_does_nothing_and_other_access_is_another_version(spark):
    none = spark.createDataFrame([], "tenant_id string, source_id string, version_id string, event string, seq long")
    cols = "tenant_id string, source_id string, text string, acl array<string>, accepted boolean"
    sources = spark.createDataFrame([("t", "s", "body", ["b", "a"], True), ("t", "bad", "x", [], False)], cols)
    events = registry.ingest(sources, none)
    assert sorted((r["source_id"], r["event"], r["seq"]) for r in events.collect()) == [("bad", "building", 1), ("bad", "failed", 2), ("s", "activated", 2), ("s", "building", 1)]
    assert [r["source_id"] for r in registry.to_ingest(sources, events).collect()] == ["bad"]
    assert registry.to_ingest(spark.createDataFrame([("t", "s", "body", ["a", "b", "a"], True)], cols), events).count() == 0
    assert registry.to_ingest(spark.createDataFrame([("t", "s", "body", ["a"], True)], cols), events).count() == 1


def test_entities_keep_priority_and_case(spark):
    df = spark.createDataFrame([("The API of Alpha Service uses \"beta gateway\" and api",)], "t string")
    got = df.select(entities.candidates(F.col("t"))).first()[0]
    assert got[:3] == ["API", "Alpha Service", "beta gateway"] and "api" not in got and "The" not in got
    assert entities.canonical("  Ｆｕｌｌ  Straße ") == "full strasse"


def test_graph_of_chunks(spark):
    rows = [("t", 1, "c1", "Alpha Service calls Beta Gateway"), ("t", 1, "c2", "ALPHA SERVICE again"), ("u", 2, "c3", "Alpha Service")]
    nodes, mentions, relations = entities.build_graph(spark.createDataFrame(rows, "tenant_id string, doc_id long, chunk_id string, chunk_text string"))
    names = {(r["tenant_id"], r["name"].lower()) for r in nodes.collect()}
    assert {("t", "alpha service"), ("t", "beta gateway"), ("u", "alpha service")} <= names
    assert {r["kind"] for r in relations.collect()} == {"CO_OCCURS_WITH", "MENTIONS_ENTITY"} and mentions.count() >= 4


def test_tables_repeat_their_header_and_texts_keep_to_the_budget():
    table = "name | value\n" + "\n".join(f"row{i} | {i}" for i in range(30))
    got = chunking.parent_child([("heading", "Head"), ("table", table), ("paragraph", "w " * 100), ("paragraph", "tail words")], 20, 24, 4)
    assert all(c.startswith("Head\nname | value") for _, k, c in got if k == "table") and sum(k == "table" for _, k, _ in got) > 1
    assert all(chunking.count_tokens(c) <= 30 for _, k, c in got if k == "text") and {s for s, *_ in got} == {1}
    assert chunking.split_hard("one two three four five six seven", 3, 1) == ["one two three", "three four five", "five six seven"]
    assert chunking.split_table("h\na b\n\nc d\ne", 3) == ["h\na b", "h\nc d", "h\ne"] and chunking.split_table("h\na", 1) == ["h\na"]
    assert chunking.split_hard("", 5, 1) == [] and chunking.split_hard("a b c", 1, 0) == ["a", "b", "c"]


def test_short_evidence_is_searched_again(spark):
    chunks = [(f"c{i}", t, "s", f"chunk:{i}", "en", []) for i, t in enumerate(["alpha beta gamma", "delta epsilon", "unrelated words here", "more filler text", "and yet another one"])]
    df = spark.createDataFrame(chunks, "chunk_id string, chunk_text string, source_id string, locator string, metadata_text string, acl array<string>")
    queries = spark.createDataFrame([(1, "alpha beta?"), (2, "nothing known")], "query_id long, text string")
    got = {(r["query_id"], r["chunk_id"]): r["sufficient"] for r in orchestrate.retrieve(df, queries, 3).collect()}
    assert got == {(1, "c0"): True}

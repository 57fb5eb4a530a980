import __spark_entry__
from sparkloom import catalog

SF = "/root/testdata/sf0.001"


def test_oracles_name_known_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 100
    assert set(catalog.queries()) <= set(__spark_entry__.queries())


def test_entry_gives_rows(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"query_id", "rank", "chunk_id", "vector", "lexical", "metadata", "rrf", "rerank"}


def test_a_sample_of_queries_equals_their_oracles(spark):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents benchmark conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("parse_quality_report", "active_version_visible", "context_budget_fit", "kg_expand_two_hops", "idempotency_outcomes", "rollup_labels"):
        out = con.sql(catalog.oracle_sql()[name])
        df = catalog.queries()[name](spark, SF).select(*out.columns)
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, out.fetchall())), name


def test_lsh_neighbours_reach_the_recall_of_an_index(spark):
    for sf in ("sf0.001", "sf0.01"):
        found, exact = ({(r["query_id"], r["vec_id"]) for r in catalog.queries()[n](spark, f"/root/testdata/{sf}").collect()} for n in ("lsh_ann_topk", "cosine_topk"))
        assert len(found) == len(exact) and len(found & exact) >= 0.9 * len(exact)


def test_lsh_neighbours_are_five_even_without_candidates(spark, tmp_path):
    # all but one vector point the other way
    rows = [(i, [float((j * 7 + i) % 3 + 1) * (1 if i == 60 else -1) for j in range(64)], 0) for i in range(55, 66)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert catalog.queries()["lsh_ann_topk"](spark, str(tmp_path)).count() == 5
